"""Queries over sentences: chapters and highlights.  A turn of a conversation is a sentence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators import chapters as ch
from tidemark.operators import highlights as hl
from tidemark.plans.inputs import table

OPENERS, CUES, QUESTIONS = ("ok", "sure", "yes", "thanks", "hello"), ("secret", "best", "never", "free", "value", "data"), ("what", "why", "how", "can", "is")
STOCK = ("thanks for watching", "see you next time")


def sentences(s, d):
    turns = table(s, d, "conversations").select(F.col("conv_id").alias("key"), "turn", "text", F.size(F.filter(F.split("text", "[ \n\t]+"), lambda w: w != "")).alias("size")).where("size > 0")
    line = Window.partitionBy("key").orderBy("turn")
    off = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = turns.select("key", "text", "size", off.alias("a"), (F.row_number().over(line) - 1).cast("long").alias("n")).withColumn("b", F.col("a") + F.col("size") - 1)
    t0 = lambda c: F.col(c) * 1000 + F.col(c) * 37 % 7 * 100
    return rows.select("key", "n", t0("a").alias("t0"), (t0("b") + 200 + F.col("b") * 53 % 5 * 100).alias("t1"), "text")


SENTENCES = """sents as (select key, n, a * 1000 + a * 37 % 7 * 100 as t0, b * 1000 + b * 37 % 7 * 100 + 200 + b * 53 % 5 * 100 as t1, text from (
  select conv_id as key, text, cast(sum(size) over w - size as bigint) as a, cast(sum(size) over w - 1 as bigint) as b, row_number() over w - 1 as n from (
    select *, len(list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda x: x <> '')) as size from conversations) where size > 0 window w as (partition by conv_id order by turn)))"""


def scope(s, d):
    return sentences(s, d).groupBy("key").agg((F.min("t0") - 700).alias("t0"), (F.max("t1") + 900).alias("t1")).withColumn("id", F.lit(0).cast("long"))


SCOPE = "scopes as (select key, min(t0) - 700 as t0, max(t1) + 900 as t1 from sents group by key)"
GAPS = "gapped as (select s.*, greatest(s.t0 - coalesce(lag(s.t1) over (partition by s.key order by n), c.t0), 0) as gap, c.t0 as lo, c.t1 as hi from sents s join scopes c on c.key = s.key)"


def gapped(s, d):
    return ch.gaps(sentences(s, d), scope(s, d))


def bags(s, d):
    tokens = sentences(s, d).select("key", "n", F.explode(tx.tokens(F.col("text"))).alias("token")).where(F.length("token") >= 4)
    return tokens.groupBy("key", "n", "token").agg(F.count(F.lit(1)).alias("tf"))


BAGS = "bags as (select key, n, token, count(*) as tf from (select key, n, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '')) as token from sents) where length(token) >= 4 group by all)"


def titled(s, d):
    return sentences(s, d).select("key", F.col("t0").alias("t"), F.when(F.col("n") % 4 == 2, " ").otherwise(F.concat(F.lit("c"), F.col("n").cast("string"))).alias("title"), (F.col("n") % 5 != 3).alias("on"))


TITLED = "titled as (select key, t0 as t, case when n % 4 = 2 then ' ' else 'c' || n end as title, n % 5 <> 3 as \"on\" from sents)"


def ranges(s, d):
    """The first three fifths of a key's time, and what follows a second later."""
    ends = sentences(s, d).groupBy("key").agg(F.min("t0").alias("a"), F.max("t1").alias("b")).withColumn("m", F.col("a") + F.floor((F.col("b") - F.col("a")) * 3 / 5).cast("long"))
    two = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.col("a").alias("t0"), F.col("m").alias("t1")), F.struct(F.lit(1).cast("long").alias("id"), (F.col("m") + 1000).alias("t0"), F.col("b").alias("t1")))
    return ends.select("key", F.explode(two).alias("x")).select("key", "x.*")


RANGES = "ranges as (select key, x.id as id, x.t0 as t0, x.t1 as t1 from (select key, unnest([struct_pack(id := 0, t0 := a, t1 := m), struct_pack(id := 1, t0 := m + 1000, t1 := b)]) as x from (select *, a + (b - a) * 3 // 5 as m from (select key, min(t0) as a, max(t1) as b from sents group by key))))"
WORDS = "list_filter(list_transform(string_split_regex(lower({0}), '[ \\n\\t\\r\\v\\f]+'), lambda w: regexp_replace(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_\\-]+', '', 'g'), '^-+|-+$', '', 'g')), lambda w: w <> '')"
UNITS = f"""inner_ as (select s.*, r.id as rid, r.t0 as r0, r.id is not null and not regexp_matches(text, 'e[.!?]$') as ok from sents s left join ranges r on r.key = s.key and r.t0 <= (s.t0 + s.t1) // 2 and (s.t0 + s.t1) // 2 < r.t1),
  holed as (select *, sum(case when coalesce(prev, true) then 0 else 1 end) over (partition by key order by n) as holes from (select *, lag(ok) over (partition by key order by n) as prev from inner_)),
  cut as (select *, case when coalesce(lag(holes) over w <> holes or lag(rid) over w <> rid, true) then 1 else 0 end as new, t0 - coalesce(lag(t1) over w, r0) as gap, row_number() over w - 1 as i from holed where ok window w as (partition by key order by n)),
  units as (select key, i as n, t0, t1, text, cast(sum(new) over (partition by key order by i) - 1 as bigint) as grp, rid as "range", len({WORDS.format('text')}) between 1 and 3 and len(list_filter({WORDS.format('text')}, lambda w: w not in {OPENERS})) = 0 as filler, gap from cut)"""


def units(s, d):
    return hl.units(sentences(s, d), ranges(s, d), "e[.!?]$", OPENERS)


def starts(s, d):
    u = units(s, d)
    return u.select("key", F.col("n").alias("id"), F.col("n").alias("a"), (F.col("n") + F.col("n") % 3).alias("b"))


S = lambda body, *more: f"with recursive {', '.join([SENTENCES, SCOPE, GAPS, *more])} {body}"
HITS = f"(len(list_filter({WORDS.format('text')}, lambda w: w in {CUES} or regexp_matches(w, '^[0-9]+$'))) + length(text) - length(replace(text, '?', '')))"

ALL = {
    "chapter_counts": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", *(ch.wanted(F.col("o_custkey") * 40, m).alias(m) for m in ("normal", "less", "more")), hl.clip_count(F.col("o_custkey") * 9, 36.0).alias("clips")),
        "select o_orderkey, cast(b as int) as normal, cast(greatest(round_even(b * 0.6, 0), 3) as int) as less, cast(least(round_even(b * 1.6, 0), 25) as int) as more, cast(least(greatest(round_even(o_custkey * 9 / 210, 0), least(3, floor(o_custkey * 9 / 43.2)), 1), 20) as int) as clips from (select *, greatest(least(round_even(o_custkey * 40 / 240, 0), 15), 3) as b from orders)",
    ),
    "real_sentences": (
        lambda s, d: ch.real_sentences(sentences(s, d).withColumn("text", F.when(F.col("n") % 3 == 0, "Thanks for watching!").when(F.col("n") % 3 == 1, F.concat(F.lit("ya ya ya "), F.substring("text", 1, 3))).otherwise(F.col("text"))), STOCK).select("key", "n"),
        S("""select key, n from (select key, n, text, list_filter(list_transform(string_split_regex(lower(text), '[ \\n\\t\\r\\v\\f]+'), lambda w: regexp_replace(w, '^[.,!?]+|[.,!?]+$', '', 'g')), lambda w: w <> '') as w from (select key, n, case when n % 3 = 0 then 'Thanks for watching!' when n % 3 = 1 then 'ya ya ya ' || substr(text, 1, 3) else text end as text from sents))
          where not (contains(lower(text), 'thanks for watching') or contains(lower(text), 'see you next time')) and not (length(array_to_string(w, ' ')) >= 6 and len(w) <= 4 and (contains('thanks for watching', array_to_string(w, ' ')) or contains('see you next time', array_to_string(w, ' '))))
          and not (len(w) >= 4 and 2 * coalesce(list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))), 0) > len(w))"""),
    ),
    "chapter_blocks": (
        lambda s, d: ch.blocks(gapped(s, d), 30_000, 400),
        S("""select key, done.s0 as s0, done.s1 as s1, done.t0 as t0, done.t1 as t1 from walk where done is not null union all select key, s, n, a, e from walk qualify row_number() over (partition by key order by n desc) = 1""",
          """walk as (select key, n, n as s, t0 as a, t1 as e, cast(null as struct(s0 bigint, s1 bigint, t0 bigint, t1 bigint)) as done from gapped where n = 0 union all
          select g.key, g.n, case when c then g.n else w.s end, case when c then g.t0 else w.a end, g.t1, case when c then struct_pack(s0 := w.s, s1 := w.n, t0 := w.a, t1 := w.e) end from walk w join gapped g on g.key = w.key and g.n = w.n + 1, lateral (select g.t1 - w.a > 30000 and (g.gap > 400 or 2 * (g.t1 - w.a) > 90000) as c) l)"""),
    ),
    "chapter_parts": (
        lambda s, d: ch.parts(sentences(s, d).select("key", F.col("n").alias("s0"), "t0", "t1"), 40_000),
        S("select key, n as s0, t0, t1, cast(floor(p / ceil(c / greatest(least(round_even(span / 40000, 0), c), 1))) as bigint) as part from (select key, n, t0, t1, row_number() over (partition by key order by t0) - 1 as p, count(*) over (partition by key) as c, max(t1) over (partition by key) - min(t0) over (partition by key) as span from sents)"),
    ),
    "boundary_scores": (
        lambda s, d: ch.boundary_scores(gapped(s, d), bags(s, d), 60_000, 40, 4000, F.when(F.col("text").rlike("^[A-M]"), 350).otherwise(0)),
        S("""select g.key, g.n, cast(floor(450 * least(g.gap, 4000) / 4000 + 350 * (1 - case when qa > 0 and qb > 0 then dot / sqrt(cast(qa as double) * qb) else 0 end) + case when regexp_matches(g.text, '^[A-M]') then 350 else 0 end + 0.000001) as bigint) as score from gapped g left join (
          select key, m, sum(a * b) as dot, sum(a * a) as qa, sum(b * b) as qb from (select x.key, x.n as m, token, sum(case when y.n >= x.n then tf else 0 end) as a, sum(case when y.n < x.n then tf else 0 end) as b
            from sents x join sents y on y.key = x.key and ((y.n >= x.n and y.n < x.n + 40 and y.t0 < x.t0 + 60000) or (y.n < x.n and y.n >= x.n - 40 and y.t0 >= x.t0 - 60000)) join bags on bags.key = y.key and bags.n = y.n group by all) group by key, m) q on q.key = g.key and q.m = g.n where g.n >= 1""", BAGS),
    ),
    "chapters_validated": (
        lambda s, d: ch.validated(gapped(s, d).where("n % 3 != 1"), scope(s, d), 300, 20_000),
        S("""select key, x.n as n, x.t as t from (select key, unnest(case when len(kept) > 1 then list_filter(kept, lambda y: hi - y.t >= 20000 or y.t = lo) else kept end) as x from (select * from walk qualify row_number() over (partition by key order by r desc) = 1))""",
          "picks as (select *, row_number() over (partition by key order by n) as r from gapped where n % 3 <> 1)",
          """walk as (select key, r, lo, hi, [struct_pack(n := n, t := lo)] as kept from picks where r = 1 union all
          select p.key, p.r, p.lo, p.hi, case when greatest(p.lo, p.t0 - least(300, p.gap // 2)) - w.kept[-1].t >= 20000 then list_append(w.kept, struct_pack(n := p.n, t := greatest(p.lo, p.t0 - least(300, p.gap // 2)))) else w.kept end from walk w join picks p on p.key = w.key and p.r = w.r + 1)"""),
    ),
    "chapters_merged": (lambda s, d: ch.merged(titled(s, d), scope(s, d), 3, 15_000), None),
    "chapter_issues": (
        lambda s, d: ch.issues(titled(s, d).where("on"), scope(s, d), 500, 12_000),
        S("""select key, unnest(list_filter([case when p = 1 and t - lo > 500 then 'FIRST' end, case when e - t < 12000 then 'SHORT' end, case when trim(title) = '' then 'EMPTY' end], lambda x: x is not null)) as code, t from (
          select o.*, c.t0 as lo, coalesce(lead(t) over w, c.t1) as e, row_number() over w as p from titled o join scopes c on c.key = o.key where "on" window w as (partition by o.key order by t))
          union all select c.key, 'FEW', null from scopes c where (select count(*) from titled o where o.key = c.key and "on") < 3""", TITLED),
    ),
    "chapters_edited": (
        lambda s, d: ch.edited(titled(s, d).withColumn("t", F.floor(F.col("t") / 9000) * 9000), scope(s, d), 10_000),
        S("""select key, x.t as t, x.title as title from (select key, unnest(kept) as x from (select * from walk qualify row_number() over (partition by key order by r desc) = 1))""", TITLED,
          "picks as (select o.key, o.title, least(greatest(o.t // 9000 * 9000, c.t0), c.t1) as t, row_number() over (partition by o.key order by least(greatest(o.t // 9000 * 9000, c.t0), c.t1), o.title) as r from titled o join scopes c on c.key = o.key where \"on\")",
          """walk as (select key, r, [struct_pack(t := t, title := title)] as kept from picks where r = 1 union all select p.key, p.r, case when p.t - w.kept[-1].t >= 10000 then list_append(w.kept, struct_pack(t := p.t, title := p.title)) else w.kept end from walk w join picks p on p.key = w.key and p.r = w.r + 1)"""),
    ),
    "keyword_titles": (
        lambda s, d: ch.keyword_titles(bags(s, d).groupBy("key", F.floor(F.col("n") / 3).alias("part"), "token").agg(F.sum("tf").alias("tf"))),
        S("""select key, part, row_number() over (partition by key, part order by score desc, length(token) desc, token desc) as place, token, score from (select b.key, b.part, b.token, cast(floor(1e6 * tf * tf / total * (1 + ln(parts / df)) + 0.001) as bigint) as score from b
          join (select key, token, cast(sum(tf) as bigint) as total, count(*) as df from b group by all) w on w.key = b.key and w.token = b.token join (select key, count(distinct part) as parts from b group by key) p on p.key = b.key where tf >= 2 and (parts = 1 or 5 * tf >= 2 * total))
          qualify place <= 3""", BAGS, "b as (select key, n // 3 as part, token, cast(sum(tf) as bigint) as tf from bags group by all)"),
    ),
    "idf": (
        lambda s, d: ch.idf(bags(s, d)).withColumn("idf", F.round("idf", 6)),
        S("select token, count(distinct key) as df, round(ln(1 + (select count(distinct key) from bags) / count(distinct key)), 6) as idf from bags group by token", BAGS),
    ),
    "speech_units": (units, S('select key, n, t0, t1, text, grp, "range", filler, gap from units', RANGES, UNITS)),
    "highlight_windows": (
        lambda s, d: hl.windows(units(s, d), 20_000, 15_000),
        S("""select key, grp, w, min(n) as a, max(n) as b from (select u.key, u.grp, u.n, unnest(range(greatest(cast(floor((u.t0 - g0 - 20000) / 15000) as bigint) + 1, 0), (u.t0 - g0) // 15000 + 1)) as w, greatest(cast(ceil((g1 - 20000 - g0) / 15000) as bigint), 0) as last
          from units u join (select key, grp, min(t0) as g0, max(t1) as g1 from units group by all) g on g.key = u.key and g.grp = u.grp) where w <= last group by all""".replace("group by all) g", "group by key, grp) g").replace("w <= last group by all", "w <= last group by key, grp, w"), RANGES, UNITS),
    ),
    "highlight_fit": (lambda s, d: hl.fitted(units(s, d), starts(s, d), 12_000, 40_000, 20_000, 800, 350), None),
    "highlight_bounds": (
        lambda s, d: hl.bounds(units(s, d).select("key", F.col("n").alias("id"), F.col("n").alias("a"), F.col("n").alias("b")), units(s, d), ranges(s, d), 150, 350, 700),
        S("""select u.key, u.n as id, greatest(r.t0, u.t0 - least(150, greatest(u.t0 - coalesce(p, r.t0), 0) // 2)) as t0, least(r.t1, u.t1 + least(350, greatest(coalesce(q, least(r.t1, u.t1 + 700)) - u.t1, 0) // 2)) as t1
          from (select *, lag(t1) over w as p, lead(t0) over w as q from units window w as (partition by key, grp order by n)) u join ranges r on r.key = u.key and r.id = u."range" """, RANGES, UNITS),
    ),
    "hook_strength": (
        lambda s, d: sentences(s, d).select("key", "n", hl.cue_hits(F.col("text"), CUES).alias("hits"), hl.hook_strength(F.col("text"), CUES, QUESTIONS).alias("hook")),
        S(f"select key, n, cast({HITS} as int) as hits, cast(case when len({WORDS.format('text')}) = 0 then 0 else least(case when coalesce(({WORDS.format('text')})[1] in {QUESTIONS}, false) or contains(text, '?') then 30 else 0 end + 22 * {HITS}, 100) end as int) as hook from sents"),
    ),
    "rule_scores": (
        lambda s, d: table(s, d, "events").select("event_id", hl.rule_score(*(F.col("event_id") * k % 101 for k in (3, 7, 11, 13)), 0.15, F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 5) / 4)).alias("rule"), hl.composite_score(*(F.col("event_id") * k % 101 for k in (3, 7, 11, 13, 17))).alias("composite")),
        """select event_id, cast(least(greatest(round_even(round(20 + 0.6 * (0.35 * (e * 3 % 101) + 0.25 * (e * 7 % 101) + 0.15 * (e * 11 % 101) + (0.4 - 0.15) * (e * 13 % 101)) + coalesce(15 * x - case when x = 0 then 12 else 0 end, 0), 9), 0), 1), 85) as int) as rule,
          cast(round_even(round((1 - 0.1) * ((0.35 * (e * 3 % 101) + 0.2 * (e * 7 % 101) + 0.25 * (e * 11 % 101) + 0.1 * (e * 13 % 101)) / 0.9) + 0.1 * (e * 17 % 101), 9), 0) as int) as composite from (select event_id, cast(event_id as double) as e0, event_id as e, case when event_id % 3 > 0 then (event_id % 5) / 4 end as x from events)""",
    ),
    "highlight_ranks": (
        lambda s, d: hl.finished(sentences(s, d).select("key", F.col("n").alias("id"), "t0", (F.col("t0") % 97).cast("int").alias("score"), (F.col("n") % 2 == 0).alias("judged"), ((F.col("n") % 5) / 4).alias("topic"), (F.col("n") % 7 == 0).alias("ungrounded")), 3),
        S("""select key, id, score, row_number() over w as place, row_number() over w <= 3 as "on", case when score >= 80 then 'green' when score >= 60 then 'yellow' else 'orange' end as colour from (
          select key, n as id, t0, cast(least(greatest(t0 % 97 + case when n % 2 = 0 then round_even(8 * ((n % 5) / 4), 0) - case when n % 7 = 0 then 10 else 0 end else 0 end, 1), 99) as int) as score from sents) window w as (partition by key order by score desc, t0, id)"""),
    ),
}
