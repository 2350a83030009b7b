"""Queries over words in order, and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators import chapters as ch
from tidemark.operators import joins, review
from tidemark.operators import tokens as tk
from tidemark.plans.inputs import WORDS, table, words

Q = lambda body, *more: f"with {', '.join([WORDS, *more])} {body}"
#: Fixed entries of the lexicon queries (token, lemma, tier) and of the phrase queries.
LEXICON = (("the", "the", 1), ("and", "and", 1), ("de", "de", 2), ("que", "que", 2), ("la", "la", 2), ("ment", "ment", 3))
PHRASES = ("de la", "la", "que la de", "the", "en de", "de la de la de")
LEX_SQL = "lex(token, lemma, tier) as (values " + ", ".join(f"('{t}', '{m}', {n})" for t, m, n in LEXICON) + ")"


PHRASE_SQL = f"""with recursive {WORDS}, p(phrase, n) as (values {', '.join(f"('{x}', {len(x.split())})" for x in PHRASES)}),
  m as (select key, pos, n, phrase, row_number() over (partition by key order by pos) as r from (select w.key, w.pos, p.n, p.phrase from (select key, pos, list(token) over (partition by key order by pos rows between current row and 4 following) as t from words) w join p on array_to_string(w.t[1:p.n], ' ') = p.phrase and len(w.t) >= p.n
    qualify row_number() over (partition by w.key, w.pos order by p.n desc) = 1)),
  walk as (select key, r, pos + n as stop, true as taken, pos, phrase from m where r = 1 union all select m.key, m.r, case when m.pos >= w.stop then m.pos + m.n else w.stop end, m.pos >= w.stop, m.pos, m.phrase from walk w join m on m.key = w.key and m.r = w.r + 1)
  select key, pos, phrase from walk where taken"""


def lexicon(s):
    return s.createDataFrame(list(LEXICON), "token string, lemma string, tier int")


def wanted(s):
    return s.createDataFrame([(p, len(p.split())) for p in PHRASES], "phrase string, n int")


def vocabulary(s, d):
    return words(s, d).select("token").distinct()


def turns(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").cast("long").alias("n"), F.length("text").cast("long").alias("size"), F.col("text"))


def answers(s, d):
    """Every turn with all that was said before it in its conversation."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = table(s, d, "conversations")
    return turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.array_join(F.collect_list("text").over(before), " ").alias("said"))


def chapters(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("key"), (F.col("turn") * 700).alias("t"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("title"))


GRAMS2 = "grams as (select * from (select key, pos, token || ' ' || lead(token) over (partition by key order by pos) as gram from words) where gram is not null)"
CLOCK = "lpad(cast(t // 60 as varchar), 2, '0') || ':' || lpad(cast(t % 60 as varchar), 2, '0')"
LONG = "cast(t // 3600 as varchar) || ':' || lpad(cast(t // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(t % 60 as varchar), 2, '0')"


def cue(x: str) -> str:
    return f"lpad(cast({x} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({x} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({x} // 1000 % 60 as varchar), 2, '0') || ',' || lpad(cast({x} % 1000 as varchar), 3, '0')"


ENDINGS = ("ement", "ation", "ment", "tion", "ing", "ed", "es", "s")
STEM_SQL = "case " + " ".join(f"when ends_with(token, '{e}') and length(token) >= {len(e) + 3} then substr(token, 1, length(token) - {len(e)})" for e in ENDINGS) + " else token end"

ALL = {
    "tokenize": (lambda s, d: words(s, d), Q("select * from words")),
    "norm_token": (
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", tx.norm(F.col("text")).alias("norm")),
        "select conv_id, turn, regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g') as norm from conversations",
    ),
    "mask_token": (
        lambda s, d: vocabulary(s, d).select("token", tx.mask(F.col("token")).alias("stars"), tx.mask(F.col("token"), "first").alias("first"), tx.mask(F.col("token"), "full").alias("full")),
        Q("select distinct token, substr(token, 1, 1) || repeat('*', length(token) - 1) as stars, substr(token, 1, 2) || repeat('*', greatest(length(token) - 2, 0)) as first, repeat('*', length(token)) as full from words"),
    ),
    "collapse_runs": (lambda s, d: vocabulary(s, d).select("token", tx.collapse(F.col("token")).alias("collapsed")), None),
    "stem": (lambda s, d: vocabulary(s, d).select("token", tx.stem(F.col("token")).alias("stem")), Q(f"select distinct token, {STEM_SQL} as stem from words")),
    "phonetic_key": (
        lambda s, d: vocabulary(s, d).select("token", tx.phonetic(F.col("token")).alias("sound")),
        Q("select distinct token, replace(replace(replace(replace(replace(replace(token, 'ph', 'f'), 'ck', 'k'), 'qu', 'k'), 'c', 'k'), 'y', 'i'), 'z', 's') as sound from words"),
    ),
    "number_tokens": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.explode(tx.numbers(F.col("text"))).alias("number")),
        "select doc_id, unnest(regexp_extract_all(text, '[0-9]+')) as number from documents",
    ),
    "grounding": (
        lambda s, d: answers(s, d).select("conv_id", "turn", F.size(F.array_except(tx.tokens(F.col("text")), tx.tokens(F.col("said")))).alias("missing"), F.size(tx.grounded(F.col("text"), F.col("said"))).alias("numbers")),
        """with t as (select conv_id, turn, coalesce(text, '') as text, coalesce(string_agg(text, ' ') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '') as said from conversations),
        w as (select conv_id, turn, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') as a, list_filter(string_split(regexp_replace(lower(said), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') as b,
          list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), lambda x: regexp_replace(x, '[.,]', '', 'g')) as p, list_transform(regexp_extract_all(said, '[0-9]+(?:[.,][0-9]+)*'), lambda x: regexp_replace(x, '[.,]', '', 'g')) as q from t)
        select conv_id, turn, cast(len(list_filter(list_distinct(a), lambda x: not list_contains(b, x))) as int) as missing, cast(len(list_filter(list_distinct(p), lambda x: not list_contains(q, x))) as int) as numbers from w""",
    ),
    "sequence_ratio": (
        lambda s, d: vocabulary(s, d).select("token", tx.ratio(F.col("token"), F.reverse("token")).alias("ratio")), None,
    ),
    "stutter_candidates": (lambda s, d: tk.stutters(words(s, d)), Q("select * from words qualify lag(token) over (partition by key order by pos) = token")),
    "ngram_repeat_pairs": (
        lambda s, d: tk.repeated_grams(words(s, d), 2, 40),
        Q("select * from (select key, gram, pos, lead(pos) over (partition by key, gram order by pos) as next_pos from grams) where next_pos - pos <= 40", GRAMS2),
    ),
    "dense_repeat": (
        lambda s, d: tk.dense(words(s, d), 12, 5),
        Q("select key, pos, cast(len(list_distinct(w)) as int) as n_distinct from (select key, pos, list(token) over (partition by key order by pos rows between current row and 11 following) as w from words) where len(w) = 12 and len(list_distinct(w)) <= 5"),
    ),
    "phrase_split": (
        lambda s, d: tk.phrases(words(s, d), F.col("token").isin("the", "de")),
        Q("select key, phrase, min(pos) as p0, max(pos) as p1, string_agg(token, ' ' order by pos) as text from (select *, cast(sum(case when pos = 0 or token in ('the', 'de') then 1 else 0 end) over (partition by key order by pos) as bigint) as phrase from words) group by key, phrase"),
    ),
    "lexicon_lookup": (lambda s, d: tk.lexicon(words(s, d), lexicon(s)), Q("select key, pos, token, lemma, tier from words join lex using (token)", LEX_SQL)),
    "allow_list": (lambda s, d: words(s, d).join(tk.listed(lexicon(s)), "token", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n")), Q("select key, count(*) as n from words anti join lex using (token) group by key", LEX_SQL)),
    "phrase_match": (lambda s, d: tk.phrase_match(words(s, d), wanted(s)), PHRASE_SQL),
    "context_words": (
        lambda s, d: joins.context_words(words(s, d), 3),
        Q("select * from (select key, pos, token, coalesce(string_agg(token, ' ') over (partition by key order by pos rows between 3 preceding and 1 preceding), '') as before, coalesce(string_agg(token, ' ') over (partition by key order by pos rows between 1 following and 3 following), '') as after from words)"),
    ),
    "bag_counts": (lambda s, d: tk.frequencies(words(s, d)), Q("select key, token, count(*) as tf from words group by all")),
    "document_frequency": (lambda s, d: tk.document_frequency(words(s, d)), Q("select token, count(distinct key) as df, count(*) as total from words group by token")),
    "tfidf_titles": (
        lambda s, d: ch.keyword_titles(tk.frequencies(words(s, d)).where(F.length("token") >= 4).select(F.lit(0).alias("key"), F.col("key").alias("part"), "token", "tf")).select(F.col("part").alias("doc"), "place", "token", "score"),
        Q("select doc, row_number() over (partition by doc order by score desc, length(token) desc, token desc) as place, token, score from (select tf.key as doc, tf.token, cast(floor(1e6 * tf * tf / total * (1 + ln((select count(distinct key) from tf) / df)) + 0.001) as bigint) as score from tf join (select token, cast(sum(tf) as bigint) as total, count(*) as df from tf group by token) using (token) where tf >= 2 and 5 * tf >= 2 * total) qualify place <= 3", "tf as (select key, token, count(*) as tf from words where length(token) >= 4 group by all)"),
    ),
    "cosine_adjacent": (
        lambda s, d: tk.neighbour_overlap(words(s, d), 100),
        Q("select a.key, a.b, cast(coalesce((select sum(x.n * y.n) from bag x join bag y on x.key = y.key and x.b + 1 = y.b and x.token = y.token where x.key = a.key and x.b = a.b), 0) as bigint) as dot, a.q, b.q as q2, cast(floor(1000 * coalesce((select sum(x.n * y.n) from bag x join bag y on x.key = y.key and x.b + 1 = y.b and x.token = y.token where x.key = a.key and x.b = a.b), 0) / sqrt(cast(a.q as double) * b.q) + 0.000001) as bigint) as cosine from norm a join norm b on a.key = b.key and a.b + 1 = b.b", "bag as (select key, pos // 100 as b, token, count(*) as n from words group by all)", "norm as (select key, b, cast(sum(n * n) as bigint) as q from bag group by all)"),
    ),
    "youtube_lines": (
        lambda s, d: review.chapter_lines(chapters(s, d)),
        f"select key, t, case when max(t) over (partition by key) >= 3600 then {LONG} else {CLOCK} end || ' ' || title as line from (select conv_id as key, turn * 700 as t, 'Turn ' || cast(turn as varchar) as title from conversations)",
    ),
    "srt_cues": (
        lambda s, d: review.cues(turns(s, d).select("key", "n", (F.col("n") * 90_000).alias("t0"), (F.col("n") * 90_000 + F.col("size") * 61).alias("t1"), "text")),
        f"select key, n, cast(n + 1 as varchar) || chr(10) || {cue('t0')} || ' --> ' || {cue('t1')} || chr(10) || text as cue from (select conv_id as key, turn as n, turn * 90000 as t0, turn * 90000 + length(text) * 61 as t1, text from conversations)",
    ),
}
