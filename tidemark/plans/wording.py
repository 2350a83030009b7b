"""Queries over words in use: amounts, judgements by context, keywords, edits, b-roll slots, speech and markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import usage as us
from tidemark.plans import spoken, topics
from tidemark.plans.inputs import SPANS, SPOKEN, merged, side, spans

TIMES = {"thousand": 1000, "million": 1_000_000}
STRONG, BEFORE, AFTER, SWEARS, LITERAL = ("the", "your"), ("a", "to", "please"), ("you", "and", "is"), ("of", "my"), ("data", "need", "help", "how")
STOP, GOOD, SCREEN = spoken.STOP, ("help", "code", "data", "price", "market"), ("click", "page", "name")
S = lambda body, *more: f"with {', '.join([SPANS, *more])} {body}"
W = lambda body, *more: f"with {', '.join([SPOKEN, *more])} {body}"
NORM = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def figures(s, d):
    n = F.col("n")
    multiplier = F.element_at(F.array(*map(F.lit, ("thousand", "Million,", "dozen"))), (n % 3 + 1).cast("int"))
    text = F.when(n % 5 == 0, F.concat((n % 40).cast("string"), F.when(n % 2 == 0, ",5").otherwise(""))).when(n % 5 == 1, multiplier).when(n % 7 == 3, F.concat(F.lit("EUR"), n.cast("string"), F.lit(".500!"))).otherwise(F.col("text"))
    return spoken.spoken(s, d).select("key", "n", text.alias("text"))


FIGURES = """figures as (select key, n, case when n % 5 = 0 then (n % 40) || case when n % 2 = 0 then ',5' else '' end when n % 5 = 1 then (['thousand', 'Million,', 'dozen'])[n % 3 + 1]
  when n % 7 = 3 then 'EUR' || n || '.500!' else text end as text from spoken)"""


def marked(s, d):
    mark = F.when(F.col("n") % 11 == 3, ",").when(F.col("n") % 13 == 4, "!").otherwise("")
    name = F.when(F.col("text").rlike("^[a-z]"), F.concat(F.upper(F.substring("text", 1, 1)), F.substring("text", 2, 1000))).otherwise(F.col("text"))
    text = F.when(F.col("n") % 17 == 8, F.concat(name, F.lit("ooo"))).when(F.col("n") % 3 == 0, name).otherwise(F.col("text"))
    return spoken.spoken(s, d).select("key", "n", F.concat(text, mark).alias("text"), F.coalesce(F.col("seg"), F.lit(False)).alias("seg"))


CAP = "case when regexp_matches(text, '^[a-z]') then upper(substr(text, 1, 1)) || substr(text, 2) else text end"
MARKED = f"marked as (select key, n, case when n % 17 = 8 then ({CAP}) || 'ooo' when n % 3 = 0 then ({CAP}) else text end || case when n % 11 = 3 then ',' when n % 13 = 4 then '!' else '' end as text, seg from spoken)"
UPPER = "(substr({0}, 1, 1) <> lower(substr({0}, 1, 1)))"
MARK = "[,.!?;:][^\\p{L}\\p{N}_]*$"
NEAR = " + ".join(f"case when i - {j} >= c0 and lag_near_{j} then {2 if j == 1 else 1} else 0 end + case when i + {j} <= c1 and lead_near_{j} then {2 if j == 1 else 1} else 0 end" for j in (1, 2, 3))


def edits(s, d):
    """Every tenth word and the two behind it, where there are two: as many words, one fewer, or none."""
    words = spoken.spoken(s, d)
    last = words.groupBy("key").agg(F.max("n").alias("top"))
    new = F.when(F.col("n") % 30 == 0, "one two three").when(F.col("n") % 30 == 10, "only rest").otherwise(" ")
    return words.where("n % 10 = 0").join(last, "key").where("n + 2 <= top").select("key", F.col("n").alias("first"), (F.col("n") + 2).alias("last"), new.alias("new"))


def slots(s, d):
    w = spoken.spoken(s, d).withColumn("id", F.floor(F.col("n") / 12).cast("long"))
    return w.groupBy("key", "id").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("n").alias("w0"), F.max("n").alias("w1"), F.max("text").alias("kw"))


def reach(s, d):
    return spoken.spoken(s, d).groupBy("key").agg((F.min("t0") + 900).alias("t0"), (F.max("t1") - 900).alias("t1"))


CONTENT = "list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{2,}'), lambda w: string_split(w, '-')[1]), lambda w: length(w) >= 4 and w not in " + str(STOP) + ")"

ALL = {
    "amounts": (
        lambda s, d: us.amounts(figures(s, d), TIMES, "EUR"),
        W(r"""select key, n, case when glued <> '' then 1 else 2 end as size, case when glued <> '' then 'EUR ' || glued || regexp_extract(w, '[,.?!;:]+$') else replace(format('{:,}', cast(p as bigint)), ',', '.') || regexp_extract(f, '[,.?!;:]+$') end as text from (
          select *, regexp_extract(core, '^EUR\.?([0-9][0-9.,]*)$', 1) as glued, case when core = w and regexp_matches(core, '^[0-9]{1,12}([.,][0-9]{1,6})?$') then cast(replace(core, ',', '.') as double) * case lower(regexp_replace(f, '[,.?!;:]+$', '')) when 'thousand' then 1000 when 'million' then 1000000 end end as p from (
          select key, n, trim(text) as w, regexp_replace(trim(text), '[,.?!;:]+$', '') as core, trim(lead(text) over (partition by key order by n)) as f from figures)) where glued <> '' or p = floor(p)""", FIGURES),
    ),
    "context_judgement": (
        lambda s, d: us.judged(marked(s, d), F.col("n") % 4 == 0, STRONG, BEFORE, AFTER, SWEARS, LITERAL, lambda k: tx.variants(k, "s", "re"), "s"),
        W(f"""select key, n, insult, plain, insult > plain as swear from (select key, n,
            case when front and pk in {STRONG} then 3 when front and pk in {BEFORE} then 2 else 0 end + case when behind and nk in {AFTER} then 2 else 0 end
            + case when len(list_filter(range(1, length(w) - 1), lambda j: lower(w[j]) = lower(w[j + 1]) and lower(w[j]) = lower(w[j + 2]) and regexp_matches(w[j], '\\p{{L}}'))) > 0 then 2 else 0 end + case when ends_with(w, '!') then 2 else 0 end
            + case when i = a and i < b and regexp_matches(w, '[,.!][^\\p{{L}}\\p{{N}}_]*$') then 2 else 0 end + case when i = a and i = b then 2 else 0 end + case when (front and pk in {SWEARS}) or (behind and nk in {SWEARS}) then 1 else 0 end as insult,
            least(4, {NEAR}) + case when behind and {UPPER.format("w")} and {UPPER.format("nw")} and nk not in {AFTER} then 2 else 0 end + case when ends_with(k, 's') then 1 else 0 end as plain
          from (select *, i > c0 as front, i < c1 as behind from (select *, greatest(a, cs) as c0, least(b, ce) as c1 from lim)) where n % 4 = 0)""",
          MARKED, f"base as (select key, n, trim(text) as w, seg, row_number() over (partition by key order by n) as i, {NORM.format('text')} as k, regexp_matches(trim(text), '{MARK}') as ends from marked)",
          f"forms as (select *, k in {LITERAL} or (ends_with(k, 's') and length(k) > 2 and substr(k, 1, length(k) - 1) in {LITERAL}) or (starts_with(k, 're') and length(k) > 3 and substr(k, 3) in {LITERAL}) as near from base)",
          "flags as (select *, " + ", ".join(f"{f}(near, {j}) over w as {f}_near_{j}" for f in ("lag", "lead") for j in (1, 2, 3)) + """, lag(k) over w as pk, lead(k) over w as nk, lead(w) over w as nw, case when i = 1 or lag(seg) over w then i end as o, case when lead(i) over w is null or seg then i end as c,
            case when lag(ends) over w then i end as so, case when ends then i end as sc from forms window w as (partition by key order by n))""",
          """lim as (select *, coalesce(max(o) over (partition by key order by n rows between 15 preceding and current row), i - 15) as a, coalesce(min(c) over (partition by key order by n rows between current row and 15 following), i + 15) as b,
            coalesce(max(so) over (partition by key order by n rows between 8 preceding and current row), i - 8) as cs, coalesce(min(sc) over (partition by key order by n rows between current row and 8 following), i + 8) as ce from flags)"""),
    ),
    "line_keywords": (
        lambda s, d: us.line_keywords(marked(s, d).withColumn("line", F.floor(F.col("n") / 7)), STOP),
        W(f"""select key, n // 7 as line, n, text from (select *, row_number() over (partition by key, n // 7 order by length(k) + case when regexp_matches(k, '[0-9]') then 6 else 0 end + case when {UPPER.format("text")} and n <> first then 3 else 0 end desc, n) as r from (
          select *, {NORM.format("text")} as k, min(n) over (partition by key, n // 7) as first from marked) where length(k) >= 4 and k not in {STOP}) where r = 1""", MARKED),
    ),
    "span_edits": (
        lambda s, d: us.span_edits(spoken.spoken(s, d), edits(s, d)),
        W("""select key, row_number() over (partition by key order by n, p) - 1 as n, text, t0, t1, seg from (
            select s.key, s.n, 0 as p, s.text, s.t0, s.t1, s.seg from spoken s left join e on e.key = s.key and s.n between e.n and e.n + 2 where e.n is null
            union all select e.key, e.n, p, (['one', 'two', 'three'])[p + 1], s.t0, s.t1, s.seg from e, range(3) r(p), spoken s where e.n % 30 = 0 and s.key = e.key and s.n = e.n + p
            union all select e.key, e.n, p, (['only', 'rest'])[p + 1], a.t0 + (2 * (b.t1 - a.t0) * p * 4 + 8) // 16, a.t0 + (2 * (b.t1 - a.t0) * (p + 1) * 4 + 8) // 16, p = 1 and b.seg from e, range(2) r(p), spoken a, spoken b
              where e.n % 30 = 10 and a.key = e.key and a.n = e.n and b.key = e.key and b.n = e.n + 2)""",
          "tops as (select key, max(n) as top from spoken group by key)", "e as (select s.key, s.n from spoken s join tops t on t.key = s.key where s.n % 10 = 0 and s.n + 2 <= top)"),
    ),
    "slot_scores": (
        lambda s, d: us.slot_scores(topics.sentences(s, d), STOP, GOOD, SCREEN),
        f"""with {topics.SENTENCES} select key, n, coalesce(list_filter(c, lambda w: w in {GOOD})[1], list_filter(c, lambda w: length(w) = list_max(list_transform(c, lambda x: length(x))))[1]) as kw,
          least(greatest(12 * least(len(list_distinct(c)), 4) + 18 * least(len(list_filter(c, lambda w: w in {GOOD})), 2) - 22 * len(list_filter(ws, lambda w: w in {SCREEN})) + case when t1 - t0 between 1500 and 10000 then 8 else 0 end, 0), 100) as score from (
          select *, {CONTENT} as c, string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ') as ws from sents) where t1 - t0 >= 800 and len(c) > 0""",
    ),
    "slot_windows": (
        lambda s, d: us.slot_windows(slots(s, d), spoken.spoken(s, d), reach(s, d), 40, 5000, 1500),
        W("""select key, id, (2 * a + 40) // 80 * 40 as t0, (2 * b + 40) // 80 * 40 as t1 from (select key, id, case when b - a < 1500 then greatest(lo, b - 1500) else a end as a, b from (
            select *, least(hi, a + want) as b from (select key, id, lo, hi, greatest(lo, a) as a, least(greatest(s1 - a + 400, 2500), 5000) as want from (
            select s.*, lo, hi, greatest(s0, coalesce((select arg_min(w.t0, w.n) from spoken w where w.key = s.key and w.n between w0 and w1 and kw <> '' and starts_with(regexp_replace(lower(w.text), '[^\\p{L}\\p{N}_]+', '', 'g'), substr(kw, 1, greatest(3, length(kw) - 2)))) - 80, s0)) as a from slots s join reach r on r.key = s.key))))""",
          "slots as (select key, n // 12 as id, min(t0) as s0, max(t1) as s1, min(n) as w0, max(n) as w1, regexp_replace(lower(max(text)), '[^\\p{L}\\p{N}_]+', '', 'g') as kw from spoken group by key, n // 12)",
          "reach as (select key, min(t0) + 900 as lo, max(t1) - 900 as hi from spoken group by key)"),
    ),
    "speech_spans": (
        lambda s, d: us.speech_spans(side(s, d, True), side(s, d, False), spans(s, d).where("id % 3 = 0").select("key", "id", "t0", "t1"), 100_000, 10_000),
        S("select key, t0, t1 from " + merged("cut"), "heard as (select key, t0, t1 from sa where t0 < t1 union all select key, t0 - 100000, t1 + 100000 from sb)",
          "cut as (select h.key, greatest(h.t0, c.t0) as t0, greatest(least(h.t1, c.t1), greatest(h.t0, c.t0) + 10000) as t1 from heard h join spans c on c.key = h.key and c.id % 3 = 0 and h.t0 < c.t1 and c.t0 < h.t1 and c.t0 < c.t1)"),
    ),
    "recording_advice": (
        lambda s, d: spans(s, d).select("id", F.array_join(us.advice(F.when(F.col("v") % 5 > 0, -80 + F.col("v") % 40), -30 + F.col("v") % 13, (F.col("v") % 4 - 2).cast("double")), ",").alias("advice")),
        S("select id, concat_ws(',', case when v % 5 > 0 and -80 + v % 40 > -60 then 'noise' end, case when -30 + v % 13 < -24 then 'quiet' end, case when v % 4 - 2 > -0.5 then 'peak' end) as advice from spans"),
    ),
    "highlight_markers": (
        lambda s, d: us.markers(spans(s, d).select("key", "id", "t0", "t1", (F.col("v") % 101).cast("int").alias("score"), F.col("kind").alias("title"), (F.col("v") % 2 == 0).alias("on")), 40),
        S("""select key, r as rank, t0 // 40 * 40 as t0, (t1 + 39) // 40 * 40 as t1, format('Clip {:02d} ({:d}) {}', r, sc, kind) as name, case when sc >= 80 then 0 when sc >= 60 then 4 else 3 end as color from (
          select *, row_number() over (partition by key order by sc desc, t0, id) as r from (select *, v % 101 as sc from spans where v % 2 = 0))"""),
    ),
}
