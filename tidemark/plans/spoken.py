"""Queries over words in time and the sound under them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import transcript as tr
from tidemark.plans.inputs import SOUNDING, SPOKEN, merged, minus, sounding, spoken, table

S = lambda body, *more: f"with recursive {', '.join([SPOKEN, *more])} {body}"
R = lambda body: f"with recursive {SPOKEN}, {body}"
NORM = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g')"
TOKENS = f"tokens as (select *, {NORM} as token, coalesce(sum(case when e then 1 else 0 end) over (partition by key order by n), 0) as segment from (select *, coalesce(lag(seg) over (partition by key order by n), false) as e from spoken))"
FEW = "few as (select key, n % 3 as m, n, text, t0, t1, seg, (['word', 'word', 'other', 'word', '12', 'word', 'la', 'word'])[n * n % 8 + 1] as token from spoken)"
#: Words of a small vocabulary, so that loops occur: token by place.
VOCABULARY = ("word", "word", "other", "word", "12", "word", "la", "word")


def few(s, d):
    place = (F.col("n") * F.col("n") % len(VOCABULARY) + 1).cast("int")
    return spoken(s, d).withColumn("text", F.element_at(F.array(*map(F.lit, VOCABULARY)), place))


def cuts(s, d):
    """Every tenth pause and some words: key, id, t0, t1."""
    return spoken(s, d).where("n % 10 = 3 or n % 17 = 5").select("key", F.col("n").alias("id"), (F.col("t0") - 150).alias("t0"), (F.col("t1") + 40).alias("t1"))


CUTS = "cuts as (select key, n as id, t0 - 150 as t0, t1 + 40 as t1 from spoken where n % 10 = 3 or n % 17 = 5)"
IN_FRAMES = "(select key, n, t0 // 10 as a, {0} as b from spoken)"


def parts(s, d):
    """Words as a recogniser writes them: a leading space, but for every fifth and each that starts with a capital third."""
    lead = F.when((F.col("n") % 5 == 2) | (F.col("n") % 7 == 3), "").otherwise(" ")
    return spoken(s, d).withColumns({"text": F.concat(lead, "text"), "seg": F.col("seg") | (F.col("n") % 4 == 1)})


def recognised(s, d):
    """Segments with the measures of a recogniser, one per order line."""
    line = table(s, d, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 10).alias("no_speech"), (F.col("l_tax") * -15).alias("logprob"), (F.col("l_quantity") / 15).alias("compression"),
        (F.col("l_discount") * 5 + 0.3).alias("prob"), F.concat(F.col("l_returnflag"), F.lit(" thanks")).alias("text"),
    )


def edited(s, d):
    w = spoken(s, d)
    return w.select(
        "key", "n", "text", F.when(F.col("n") % 5 == 0, F.lit("mine")).alias("user_text"), F.when(F.col("n") % 3 == 0, F.lit("auto")).alias("auto_text"), (F.col("n") % 11 == 0).alias("hidden"),
        F.when(F.col("n") % 4 == 0, F.col("n") % 8 == 0).alias("censor"), (F.col("n") % 6 == 0).alias("rule_censor"),
    )


#: Fixed parameters of the scalar queries.
SUFFIXES, PREFIXES, STOP = "ment|tion|s", "re|de|in", ("this", "that", "with", "from", "para", "dans")
ENDINGS, STARTS = ("ations", "ation", "ment", "er", "s"), ("inter", "re", "de")


def vocabulary(s, d):
    return table(s, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token")).distinct()


VOCAB = f"vocab as (select distinct unnest(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')) as token from documents)"
V = lambda body: f"with {VOCAB} {body}"
FORMS = f"[token, regexp_replace(token, '({SUFFIXES})$', ''), regexp_replace(token, '^({PREFIXES})', '')]"
CUT_END = "case " + " ".join(f"when ends_with(token, '{e}') and length(token) >= {len(e) + 4} then substr(token, 1, length(token) - {len(e)})" for e in ENDINGS) + " else token end"
CUT_START = "case " + " ".join(f"when starts_with(c, '{e}') and length(c) >= {len(e) + 4} then substr(c, {len(e) + 1})" for e in STARTS) + " else c end"
STEMS = f"stems as (select token, case when length(token) < 6 then token else {CUT_START} end as stem from (select token, {CUT_END} as c from vocab))"


def stems(s, d):
    return vocabulary(s, d).select("token", tx.stripped_stem(F.col("token"), ENDINGS, STARTS).alias("stem"))


def neighbours(s, d):
    """Pairs of vocabulary words with the same first three letters, by key; no word meets more than its group's next ones."""
    w = stems(s, d).where(F.length("token") >= 3).withColumn("g", F.substring("token", 1, 3))
    nxt = tr.Window.partitionBy("g").orderBy("token")
    pairs = w.select("token", "stem", F.lead("token").over(nxt).alias("other"), F.lead("stem").over(nxt).alias("other_stem"))
    return pairs.where("other is not null")


ALL = {
    "spoken_phrases": (
        lambda s, d: tr.phrases(spoken(s, d), 600),
        S("""select key, phrase, min(n) as w0, max(n) as w1, min(t0) as t0, max(t1) as t1 from (select *, cast(sum(c) over (partition by key order by n) as bigint) as phrase from (
          select *, case when coalesce(lag(seg) over w or regexp_matches(lag(text) over w, '[.?!]$') or t0 - lag(t1) over w >= 600, false) then 1 else 0 end as c from spoken window w as (partition by key order by n))) group by key, phrase"""),
    ),
    "segment_loops": (
        lambda s, d: tr.segment_loops(few(s, d)),
        S(
            "select key, segment, token, count(*) as n from t where regexp_matches(token, '^\\p{L}+$') and length(token) >= 4 group by key, segment, token having count(*) >= 4 and count(*) * 2 > (select count(*) from t x where x.key = t.key and x.segment = t.segment)",
            FEW, "t as (select *, cast(coalesce(sum(case when e then 1 else 0 end) over (partition by key order by n), 0) as bigint) as segment from (select *, coalesce(lag(seg) over (partition by key order by n), false) as e from few))",
        ),
    ),
    "dense_loops": (
        lambda s, d: tr.dense_loops(few(s, d)),
        S("""select key, n, last from (select key, n, last, len(list_distinct(list_transform(list_filter(w, lambda x: x.n <= last), lambda x: x.token))) as d from (
          select key, n, w, list_max(list_transform(list_filter(w, lambda x: x.token = token), lambda x: x.n)) as last from (
          select key, n, token, list_filter(list(struct_pack(n := n, token := token, t0 := t0)) over (partition by key order by n rows between current row and 11 following), lambda x: x.t0 - t0 < 15000) as w from few)
          where regexp_matches(token, '^\\p{L}+$') and length(token) >= 4 and len(list_filter(w, lambda x: x.token = token)) >= 4)) where d <= 5""", FEW),
    ),
    "back_to_back": (lambda s, d: tr.back_to_back(few(s, d), {1: 4, 2: 3, 3: 3, 4: 3}, 1200), None),
    "timed_sentences": (
        lambda s, d: tr.sentences(spoken(s, d), 1300, 6_000, 4),
        R("""walk as (select key, n, n as s, t0 as a, t1 as e, seg, text, cast(null as struct(w0 bigint, w1 bigint, t0 bigint, t1 bigint)) as done from spoken where n = 0 union all
          select w.key, w.n, case when c then w.n else k.s end, case when c then w.t0 else k.a end, w.t1, w.seg, w.text, case when c then struct_pack(w0 := k.s, w1 := k.n, t0 := k.a, t1 := k.e) end
          from walk k join spoken w on w.key = k.key and w.n = k.n + 1, lateral (select k.text[-1:] in ('.', '?', '!') or w.t0 - k.e >= 1300 or w.t1 - k.a > 12000 or (k.seg and (w.n - k.s >= 4 or w.t1 - k.a > 6000)) as c) l)
          select key, done.w0 as w0, done.w1 as w1, done.t0 as t0, done.t1 as t1 from walk where done is not null union all select key, s, n, a, e from walk qualify row_number() over (partition by key order by n desc) = 1"""),
    ),
    "caption_lines": (
        lambda s, d: tr.caption_lines(spoken(s, d), 24, 1200, 5_000),
        R("""walk as (select key, n, n as s, t0 as a, t1 as e, seg, text, text as held, cast(null as struct(w0 bigint, w1 bigint, text varchar)) as done from spoken where n = 0 union all
          select w.key, w.n, case when c then w.n else k.s end, case when c then w.t0 else k.a end, w.t1, w.seg, w.text, case when c then w.text else k.held || ' ' || w.text end, case when c then struct_pack(w0 := k.s, w1 := k.n, text := k.held) end
          from walk k join spoken w on w.key = k.key and w.n = k.n + 1, lateral (select length(k.held) + 1 + length(w.text) > 24 or w.t0 - k.e > 1200 or w.t1 - k.a > 5000 or k.seg or k.text[-1:] in ('.', '?', '!') as c) l)
          select key, done.w0 as w0, done.w1 as w1, done.text as text from walk where done is not null union all select key, s, n, held from walk qualify row_number() over (partition by key order by n desc) = 1"""),
    ),
    "joined_continuations": (
        lambda s, d: tr.joined_continuations(parts(s, d)),
        R("""parts as (select key, n, case when n % 5 = 2 or n % 7 = 3 then '' else ' ' end || text as text, t0, t1, seg or n % 4 = 1 as seg from spoken),
          walk as (select key, n, n as s, case when text[1] = ' ' then text else ' ' || text end as held, t0 as a, t1 as e, seg, cast(null as struct(n bigint, text varchar, t0 bigint, t1 bigint, seg boolean)) as done from parts where n = 0 union all
          select w.key, w.n, case when c then k.s else w.n end, case when c then k.held || w.text when w.text[1] = ' ' then w.text else ' ' || w.text end, case when c then k.a else w.t0 end, case when c then greatest(k.e, w.t1) else w.t1 end, case when c then k.seg or w.seg else w.seg end,
            case when not c then struct_pack(n := k.s, text := k.held, t0 := k.a, t1 := k.e, seg := k.seg) end
          from walk k join parts w on w.key = k.key and w.n = k.n + 1, lateral (select w.text[1] <> ' ' and not (k.seg and upper(w.text[1]) = w.text[1] and lower(w.text[1]) <> w.text[1]) as c) l)
          select key, done.n as n, done.text as text, done.t0 as t0, done.t1 as t1, done.seg as seg from walk where done is not null union all select key, s, held, a, e, seg from walk qualify row_number() over (partition by key order by n desc) = 1"""),
    ),
    "kept_segments": (
        lambda s, d: tr.kept_segments(recognised(s, d), "^R thanks").select("l_orderkey", "l_linenumber", "l_partkey"),
        "select l_orderkey, l_linenumber, l_partkey from lineitem where not ((l_discount * 10 > 0.6 and l_tax * -15 < -1.0) or l_quantity / 15 > 2.4 or l_tax * -15 < -0.7) and l_discount * 5 + 0.3 >= 0.5 and l_returnflag <> 'R'",
    ),
    "shown_words": (
        lambda s, d: tr.shown_words(edited(s, d)),
        S("select key, n, case when coalesce(case when n % 4 = 0 then n % 8 = 0 end, n % 6 = 0) then repeat('*', length(x)) else x end as shown from (select *, case when n % 5 = 0 then 'mine' when n % 3 = 0 then 'auto' else text end as x from spoken where n % 11 <> 0)"),
    ),
    "sounding_share": (
        lambda s, d: tr.sounding_share(spoken(s, d), sounding(s, d), 10),
        S(f"select w.key, w.n, 1000 * count(f.i) // any_value(w.b - w.a) as share from {IN_FRAMES.format('greatest(t1 // 10, t0 // 10 + 1)')} w left join sounding f on f.key = w.key and f.i >= w.a and f.i < w.b group by w.key, w.n", SOUNDING),
    ),
    "audible_loss": (
        lambda s, d: tr.audible_loss(spoken(s, d), sounding(s, d), cuts(s, d), 10),
        S(
            f"select w.key, w.n, case when count(f.i) >= 3 then 1000 * count(f.i) filter (exists (select 1 from cuts c where c.key = f.key and c.t0 // 10 <= f.i and f.i < c.t1 // 10)) // count(f.i) end as loss from {IN_FRAMES.format('t1 // 10 + 1')} w left join sounding f on f.key = w.key and f.i >= w.a and f.i < w.b group by w.key, w.n".replace("count(f.i) filter (exists (select 1 from cuts c where c.key = f.key and c.t0 // 10 <= f.i and f.i < c.t1 // 10))", "count(f.i) filter (f.cut)").replace("left join sounding f", "left join cutframes f"),
            SOUNDING, CUTS, "cutframes as (select f.key, f.i, bool_or(c.id is not null) as cut from sounding f left join cuts c on c.key = f.key and c.t0 // 10 <= f.i and f.i < c.t1 // 10 group by 1, 2)",
        ),
    ),
    "audible_edges": (
        lambda s, d: tr.audible_edges(spoken(s, d), sounding(s, d), 10),
        S(f"select w.key, w.n, min(f.i) * 10 as first, (max(f.i) + 1) * 10 as last from {IN_FRAMES.format('t1 // 10 + 1')} w left join sounding f on f.key = w.key and f.i >= w.a and f.i < w.b group by w.key, w.n", SOUNDING),
    ),
    "destretched": (
        lambda s, d: tr.destretched(spoken(s, d), sounding(s, d), 10, 30, 50, 40),
        S(
            "select key, n, case when f > t0 // 10 and x - t0 >= 50 then x else t0 end as t0, t1 from (select *, least(greatest(t0, f * 10 - 30), t1 - 40) as x from (select w.key, w.n, w.t0, w.t1, min(f.i) as f from spoken w left join sounding f on f.key = w.key and f.i >= w.t0 // 10 and f.i < w.t1 // 10 + 1 group by w.key, w.n, w.t0, w.t1))", SOUNDING,
        ),
    ),
    "uncovered_sound": (
        lambda s, d: tr.uncovered_sound(sounding(s, d), spoken(s, d).where("n % 4 != 1"), 10, 60, 20, 10, 5),
        S(
            """select key, t0, t1, voiced from (select key, min(t0) as t0, max(t1) as t1, cast(sum(t1 - t0) as bigint) as voiced from (select *, sum(c) over (partition by key order by t0) as g from (
              select *, case when coalesce(t0 - lag(t1) over (partition by key order by t0) >= 60, true) then 1 else 0 end as c from rest)) group by key, g) where t1 - t0 >= 20 and voiced >= 10 qualify row_number() over (partition by key order by t0) <= 5""",
            SOUNDING, "f as (select key, i as t0, i + 1 as t1 from sounding)", f"ia as {merged('f')}", "c as (select distinct key, t0 // 10 as t0, t1 // 10 + 1 as t1 from spoken where n % 4 <> 1)", f"ib as {merged('c')}", f"rest as {minus('ia', 'ib')}",
        ),
    ),
    "nearest_cut": (
        lambda s, d: tr.nearest_cut(spoken(s, d), cuts(s, d), 600),
        S("select w.key, w.n, c.id as cut from spoken w join cuts c on c.key = w.key and greatest(0, c.t0 - w.t1, w.t0 - c.t1) < 600 qualify row_number() over (partition by w.key, w.n order by greatest(0, c.t0 - w.t1, w.t0 - c.t1), c.t0, c.id) = 1", CUTS),
    ),
    "context_in_time": (
        lambda s, d: tr.context_in_time(cuts(s, d), spoken(s, d), 3),
        S(
            """select c.key, c.id, coalesce((select string_agg(text, ' ' order by r) from e where e.key = c.key and e.r > c.a - 3 and e.r <= c.a), '') as pre,
              coalesce((select string_agg(text, ' ' order by r) from e where e.key = c.key and e.r > c.b and e.r <= c.b + 3), '') as post
              from (select c.key, c.id, count(e.r) filter (e.t1 <= c.t0) as a, count(e.r) filter (e.t1 <= c.t1) as b from cuts c left join e on e.key = c.key group by 1, 2) c""",
            CUTS, "e as (select *, row_number() over (partition by key order by t1, n) as r from spoken)",
        ),
    ),
    "filler_cuts": (
        lambda s, d: tr.filler_cuts(tr.gaps(spoken(s, d), 9000).where("n % 6 = 1"), 20, 300, 500, 600, 80),
        S(
            """select key, n, greatest(case when a > b then t0 - 20 else t0 - least(b, 600) + 80 end, 0) as t0, case when a > b then t1 + least(a, 600) - 80 else t1 + 20 end as t1 from (
              select *, coalesce(t0 - lag(t1) over w, 9000) as b, coalesce(lead(t0) over w - t1, 9000) as a from spoken window w as (partition by key order by n)) where n % 6 = 1 and (t1 - t0 >= 300 or greatest(a, b) >= 500)""",
        ),
    ),
    "clipped_to_gaps": (
        lambda s, d: tr.clipped_to_gaps(spoken(s, d).select("key", "n", (F.col("t0") + 250).alias("t0"), (F.col("t0") + 1500).alias("t1")), spoken(s, d).where("n % 2 = 0"), 30, 40),
        S(
            """select key, n, t0, t1 from (select i.key, i.n, greatest(i.t0, coalesce(max(w.t1 + 30) filter (w.t0 - 30 <= i.t0), i.t0)) as t0, least(i.t1, coalesce(min(w.t0 - 30) filter (w.t0 - 30 > i.t0), i.t1)) as t1
              from (select key, n, t0 + 250 as t0, t0 + 1500 as t1 from spoken) i left join (select * from spoken where n % 2 = 0) w on w.key = i.key and w.t0 - 30 < i.t1 and w.t1 + 30 > i.t0 group by i.key, i.n, i.t0, i.t1) where t1 - t0 > 40""",
        ),
    ),
    "voice_activity": (
        lambda s, d: tr.voice_activity(spoken(s, d).where("n % 5 != 4"), 600, 900),
        S(f"select * from {merged('v', 'e is null or (t0 > e and t0 - e >= 600)')} where t1 - t0 >= 900", "v as (select key, t0, t1 from spoken where n % 5 <> 4)"),
    ),
    "norm_hyphen": (
        lambda s, d: spoken(s, d).select("key", "n", tx.norm_hyphen(F.concat(F.lit("-"), "text", F.lit("-x."))).alias("hyphen"), tx.bare(F.concat(F.lit("'"), "text", F.lit("-y!"))).alias("bare")),
        S("select key, n, regexp_replace(regexp_replace(lower('-' || text || '-x.'), '[^\\p{L}\\p{N}_\\-]+', '', 'g'), '^-+|-+$', '', 'g') as hyphen, replace(regexp_replace(lower('''' || text || '-y!'), '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g'), '-', '') as bare from spoken"),
    ),
    "undisguised": (
        lambda s, d: vocabulary(s, d).select("token", tx.undisguised(F.concat(F.substring("token", 1, 2), F.lit("4$"), "token")).alias("plain"), tx.undisguised(F.col("token")).alias("own")),
        V("select token, regexp_replace(case when regexp_matches(x, '[a-z]') then translate(x, '01345789@$', 'oieastbgas') else x end, '[^a-z*]', '', 'g') as plain, regexp_replace(case when regexp_matches(token, '[a-z]') and regexp_matches(token, '[0-9@$]') then translate(token, '01345789@$', 'oieastbgas') else token end, '[^a-z*]', '', 'g') as own from (select token, substr(token, 1, 2) || '4$' || token as x from vocab)"),
    ),
    "word_variants": (
        lambda s, d: vocabulary(s, d).select("token", F.array_join(tx.variants(F.col("token"), SUFFIXES, PREFIXES), "|").alias("forms")),
        V(f"select token, array_to_string(list_transform(list_filter(list_zip({FORMS}, range(3)), lambda x: (x[1] = token or length(x[1]) >= 2) and list_position({FORMS}, x[1]) = x[2] + 1), lambda x: x[1]), '|') as forms from vocab"),
    ),
    "stripped_stem": (lambda s, d: stems(s, d), V("select 1").replace("select 1", "").rstrip() + f", {STEMS} select * from stems"),
    "token_similarity": (
        lambda s, d: neighbours(s, d).select("token", "other", tx.token_similarity(F.col("token"), F.col("other"), F.col("stem"), F.col("other_stem")).alias("similarity")),
        V("").rstrip() + f""", {STEMS} select token, other, case when token = other then 100 when length(token) >= 4 and length(other) >= 4 and (starts_with(token, other) or starts_with(other, token)) then 75
          when length(stem) >= 3 and stem = other_stem then 80 when length(stem) >= 4 and length(other_stem) >= 4 and (contains(other, stem) or contains(token, other_stem)) then 60 else 0 end as similarity from (
          select token, stem, lead(token) over w as other, lead(stem) over w as other_stem from stems where length(token) >= 3 window w as (partition by substr(token, 1, 3) order by token)) where other is not null""",
    ),
    "content_tokens": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.explode(tx.content_tokens(F.col("text"), STOP)).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")),
        f"select doc_id, token, count(*) as n from (select doc_id, string_split(unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}')), '-')[1] as token from documents) where length(token) >= 4 and token not in {STOP} group by all",
    ),
    "clean_titles": (
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", tx.title(F.concat(F.lit("Chapter "), F.col("turn").cast("string"), F.lit(": \"'"), "text", F.lit(" .\"")), 40).alias("title")),
        """select conv_id, turn, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace('Chapter ' || turn || ': "''' || text || ' ."', '^[ \\t\\r\\n]*([0-9]+[ \\t\\r\\n]*[.):-][ \\t\\r\\n]*|[Cc]hapter[ \\t\\r\\n]*[0-9]+[ \\t\\r\\n]*[:.)-][ \\t\\r\\n]*)', ''), '[ \\t\\r\\n]+', ' ', 'g'), '^[ ."''`*#:;-]+|[ ."''`*#:;-]+$', '', 'g'), 1, 40), '[ ,;:-]+$', '') as title from conversations""",
    ),
    "parsed_times": (
        lambda s, d: table(s, d, "events").select("event_id", tx.seconds(tx.clock(F.col("event_id") * 7, True)).cast("long").alias("a"), tx.seconds(F.concat("event_type", F.lit(":3"))).cast("long").alias("b"), tx.seconds(F.concat(F.lit(" "), F.col("user_id").cast("string"))).cast("long").alias("c")),
        "select event_id, event_id * 7 as a, cast(null as bigint) as b, user_id as c from events",
    ),
    "decibels": (
        lambda s, d: table(s, d, "events").select("event_id", F.round(tx.decibels(F.col("value") / 100), 3).alias("db"), F.round(tx.level(tx.decibels(F.col("value") / 100)) * 100, 3).alias("back")),
        "select event_id, round(case when value > 0 then greatest(20 * log10(value / 100), -120) else -120 end, 3) as db, round(case when value > 0 then greatest(value, 0.0001) else 0.0001 end, 3) as back from events",
    ),
    "text_chunks": (
        lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t")).select("conv_id", F.posexplode(tx.chunks(F.col("t"), 200)).alias("chunk", "text")),
        """with recursive c as (select conv_id, text, row_number() over (partition by conv_id order by turn) as r from conversations), walk as (select conv_id, r, text as held, 0 as chunk from c where r = 1 union all
          select c.conv_id, c.r, case when length(w.held) + 1 + length(c.text) <= 200 then w.held || chr(10) || c.text else c.text end, w.chunk + case when length(w.held) + 1 + length(c.text) <= 200 then 0 else 1 end from walk w join c on c.conv_id = w.conv_id and c.r = w.r + 1)
          select conv_id, cast(chunk as int) as chunk, arg_max(held, r) as text from walk group by conv_id, chunk""",
    ),
    "merge_patch": (
        lambda s, d: table(s, d, "events").select("event_id", F.get_json_object(tx.merge_patch(F.col("props"), F.concat(F.lit('{"k": null, "n": '), F.col("event_id").cast("string"), F.lit("}"))), "$.n").cast("long").alias("n")),
        "select event_id, event_id as n from events",
    ),
    "box_overlap": (
        lambda s, d: table(s, d, "events").select("event_id", F.floor(1000 * tx.overlap_share(*[F.col("event_id") * k % 50 for k in (3, 7)], *[F.col("event_id") * k % 50 + 20 for k in (3, 7)], *[F.col("user_id") * k % 50 for k in (5, 11)], *[F.col("user_id") * k % 50 + 30 for k in (5, 11)])).cast("long").alias("iou")),
        """select event_id, 1000 * i // (400 + 900 - i) as iou from (select event_id, greatest(least(a + 20, c + 30) - greatest(a, c), 0) * greatest(least(b + 20, d + 30) - greatest(b, d), 0) as i from (
          select event_id, event_id * 3 % 50 as a, event_id * 7 % 50 as b, user_id * 5 % 50 as c, user_id * 11 % 50 as d from events))""",
    ),
}
