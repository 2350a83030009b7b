"""Queries over levels in decibels, votes and cells, and choices under several limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import highlights as hl
from tidemark.operators import rank, scores, silence
from tidemark.operators import series as sr
from tidemark.plans.inputs import HOUR, SERIES, SPANS, merged, minus, series, spans, table

DB = f"{SERIES}, db as (select key, i, cast(least(0, -90 + v // 40) as bigint) as v from series)"
Q = lambda body, *more: f"with {', '.join([DB, *more])} {body}"
DAY = 24 * HOUR


def db(s, d):
    return series(s, d).select("key", "i", F.least(F.lit(0), F.floor(F.col("v") / 40) - 90).cast("long").alias("v"))


def placed(s, d):
    """The levels as frames 0, 1, 2, ... of a key."""
    place = F.row_number().over(sr.line()) - 1
    return db(s, d).select("key", place.cast("long").alias("i"), "v")


PLACED = "placed as (select key, row_number() over (partition by key order by i) - 1 as i, v from db)"


def otsu_sql(source: str, name: str) -> str:
    """SQL of ``name`` (key, threshold) for the levels in ``source`` (key, v)."""
    return f"""{name}_b as (select key, least(greatest(v, -100), 0) as v, least(cast(floor(least(greatest(v, -100), 0)) as bigint), -1) as b from {source}),
    {name}_h as (select key, b, count(*) as n from {name}_b group by all),
    {name}_c as (select key, b, lead(b) over w as nb, sum(n) over w as w0, sum(n * b) over w as m0, sum(n) over (partition by key) as w1, sum(n * b) over (partition by key) as m1 from {name}_h window w as (partition by key order by b)),
    {name}_v as (select key, b, nb, s, max(s) over (partition by key) as top from (select *, cast(m1 * w0 - m0 * w1 as double) ** 2 / (w0 * (w1 - w0)) as s from {name}_c where w0 < w1)),
    {name}_p as (select *, min(case when s = top then b end) over (partition by key) as peak from {name}_v),
    {name}_e as (select key, coalesce(max(b) filter (s < top * 0.999 and b < peak), -1000) as lo, coalesce(min(b) filter (s < top * 0.999 and b > peak), 1000) as hi from {name}_p group by key),
    {name}_t as (select p.key, (min(b) + max(nb)) / 2 as t from {name}_p p join {name}_e e on e.key = p.key and p.b > lo and p.b < hi group by p.key),
    {name} as (select x.key, coalesce(t, alone) as threshold from (select key, least(quantile_cont(v, 0.1) + 20, -20) as alone from {name}_b group by key) x left join {name}_t using (key))"""


def gated_sql(source: str, name: str) -> str:
    """SQL of ``name``: ``source`` (key, i, v, threshold) with ``sounds``, by the gate of four decibels."""
    return f"""{name} as (select *, v >= threshold - 4 and bool_or(v >= threshold) over (partition by key, g) as sounds from (
      select *, sum(case when st then 0 else 1 end) over (partition by key order by i rows unbounded preceding) as g from (
        select *, v >= threshold - 4 and coalesce(lag(v >= threshold - 4) over (partition by key order by i), false) and coalesce(i - lag(i) over (partition by key order by i) = 1, false) as st from {source})))"""


MICS = f"""mdb as (select (user_id % 3) || ':' || event_type as key, epoch_us(ts) // 600000000 as i, least(0, cast(floor(sum(cast(floor(value * 100 + 0.5) as bigint)) / 15) as bigint) - 90) as v from events group by all),
  lev as (select key, i, max(v) over (partition by key order by i rows between 1 preceding and 1 following) as v from mdb), sig as (select * from lev where v > -87.5), {otsu_sql('sig', 'ot')},
  lim as (select l.key, l.i, l.v, case when coalesce(c.n, 0) >= 100 then ot.threshold else -50 end as threshold from lev l left join ot on ot.key = l.key left join (select key, count(*) as n from sig group by key) c on c.key = l.key), {gated_sql('lim', 'gt')},
  prio(key, rank) as (values ('click', 2), ('view', 2), ('purchase', 3)),
  own as (select key, i, case when one.sounds and (two is null or one.v - two.v >= 12) then one.key when n >= 2 and pr[1].r > 0 and (pr[2] is null or pr[2].r < pr[1].r) then pr[1].key when n >= 2 then 'cross' when n = 1 then 'unknown' else 'silent' end as owner from (
    select key, i, l[1] as one, l[2] as two, n, pr from (select gt.rec as key, gt.i, list(struct_pack(v := gt.v, key := gt.mic, sounds := gt.sounds) order by gt.v desc, gt.mic) as l, count(*) filter (gt.sounds) as n, list(struct_pack(r := coalesce(prio.rank, 0), key := gt.mic) order by coalesce(prio.rank, 0) desc, gt.mic) filter (gt.sounds) as pr
      from (select *, cast(split_part(key, ':', 1) as bigint) as rec, split_part(key, ':', 2) as mic from gt) gt left join prio on prio.key = gt.mic group by gt.rec, gt.i)))"""


def microphones(s, d):
    """Three recordings, one for each remainder of the users, with a microphone for each kind of event."""
    e = table(s, d, "events").select((F.col("user_id") % 3).cast("long").alias("key"), F.col("event_type").alias("mic"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000).cast("long").alias("i"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("v"))
    return e.groupBy("key", "mic", "i").agg(F.least(F.lit(0), F.floor(F.sum("v") / 15) - 90).cast("long").alias("v"))


def owners(s, d):
    return sr.frame_owner(microphones(s, d), 12, 1, -88, s.createDataFrame([("click", 2), ("view", 2), ("purchase", 3)], "mic string, rank int"))


def frame_spans(s, d):
    """Spans of 40 frames or so of a key's levels."""
    return placed(s, d).where("i % 25 = 0").select("key", F.col("i").alias("id"), F.col("i").alias("t0"), (F.col("i") + 20 + F.col("i") % 40).alias("t1"))


def spoken_at(s, d):
    return placed(s, d).where("i % 40 = 1").select("key", (F.col("i") * 10 + 3).alias("t0"), (F.col("i") * 10 + 24).alias("t1"))


def guarded(s, d):
    return placed(s, d).where("i % 90 = 7").select("key", (F.col("i") * 10).alias("t0"), (F.col("i") * 10 + 5).alias("t1"))


def scopes(s, d):
    return placed(s, d).groupBy("key").agg(F.max("i").alias("n")).select("key", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("t0"), (F.col("n") * 4).alias("t1")), F.struct((F.col("n") * 5).alias("t0"), (F.col("n") * 10).alias("t1")))).alias("x")).select("key", "x.t0", "x.t1")


SILENCE = f"""{PLACED}, {otsu_sql('placed', 'th')}, fr as (select p.*, th.threshold from placed p join th on th.key = p.key), {gated_sql('fr', 'ga')},
  wd as (select distinct key, (i * 10 + 3) // 10 as a, (i * 10 + 24) // 10 + 1 as b from placed where i % 40 = 1),
  gd as (select distinct f.key, f.i from fr f join wd on wd.key = f.key and wd.a <= f.i and f.i < wd.b where f.v >= f.threshold - 6),
  fc as (select distinct key, i from (select key, unnest(range(i - 3, i + 4)) as i from gd union all select key, i from placed where i % 90 = 7) where i >= 0 and i <= (select max(i) from placed q where q.key = key)),
  bound as (select key, max(i) as last from placed group by key), fo as (select fc.key, fc.i from fc join bound on bound.key = fc.key and fc.i <= bound.last),
  al as (select key, i as t0, i + 1 as t1 from ga where sounds union select key, i, i + 1 from fo), ru as {merged('al', 'e is null or (t0 > e and t0 - e >= 3)')},
  kp as (select key, t0 * 10 - 4 as t0, t1 * 10 + 8 as t1 from ru where t1 - t0 >= 5 or exists (select 1 from fo where fo.key = ru.key and fo.i >= ru.t0 and fo.i < ru.t1)), ik as {merged('kp')},
  sc0 as (select key, max(i) as n from placed group by key), sc as (select key, 0 as t0, n * 4 as t1 from sc0 union all select key, n * 5, n * 10 from sc0), isc as {merged('sc')}"""

CAND = "select key, id, t0, t1, v as score, kind from spans where t0 < t1"


def candidates(s, d):
    return spans(s, d).where("t0 < t1").select("key", "id", F.col("t0").alias("t"), "t0", "t1", F.col("v").alias("score"), "kind", (F.col("v") % 3 == 0).alias("busy"))


def pick_sql(candidates: str, order: str, refuse: str, body: str, *more: str) -> str:
    """Candidates (alias c) taken in order unless ``refuse`` holds given the list w.kept, by recursion over a key's rank."""
    return f"""with recursive {', '.join([SPANS, *more])}, cand as (select *, row_number() over (partition by key order by {order}) as r from ({candidates})),
      walk as (
        select key, r, [c] as kept from cand c where r = 1 and not ({refuse.replace('w.kept', '(list_filter([c], lambda z: false))')})
        union all select key, r, list_filter([c], lambda z: false) from cand c where r = 1 and ({refuse.replace('w.kept', '(list_filter([c], lambda z: false))')})
        union all
        select w.key, c.r, case when {refuse} then w.kept else list_append(w.kept, c) end from walk w join cand c on c.key = w.key and c.r = w.r + 1),
      kept as (select key, unnest(kept) as x from walk qualify r = max(r) over (partition by key)) {body}"""


DENSE = f"len(list_filter(list_append(list_filter(list_transform(w.kept, lambda y: y.t0), lambda y: abs(y - c.t0) < {DAY}), c.t0), lambda s: s <= c.t0 and len(list_filter(list_append(list_filter(list_transform(w.kept, lambda y: y.t0), lambda y: abs(y - c.t0) < {DAY}), c.t0), lambda y: y >= s and y < s + {DAY})) > 2)) > 0"
CROWD = f"len(list_filter(list_append(list_transform(w.kept, lambda y: y.t0), c.t0), lambda s: len(list_filter(list_append(list_transform(w.kept, lambda y: y.t0), c.t0), lambda y: y >= s and y < s + {2 * DAY})) > 3)) > 0"

ALL = {
    "otsu_threshold": (lambda s, d: sr.otsu(db(s, d)), Q("select * from ot", otsu_sql("db", "ot"))),
    "otsu_single_level": (lambda s, d: sr.otsu(db(s, d).withColumn("v", F.when(F.col("key") == "click", F.lit(-70)).otherwise(F.col("v")))), Q("select * from ot", "one as (select key, case when key = 'click' then -70 else v end as v from db)", otsu_sql("one", "ot"))),
    "frame_owner": (owners, Q("select * from own", MICS)),
    "lanes": (
        lambda s, d: sr.lanes(owners(s, d), 4, 2, 3),
        Q("""select key, lane, min(i) as i0, max(i) + 1 as i1 from (select *, sum(n) over (partition by key, lane order by i) as g from (
          select key, owner as lane, i, case when coalesce(i - lag(i) over (partition by key, owner order by i) > 4, true) then 1 else 0 end as n from own where owner not in ('unknown', 'silent'))) group by key, lane, g having max(i) + 1 - min(i) >= case when lane = 'cross' then 3 else 2 end""", MICS),
    ),
    "z_scores": (
        lambda s, d: sr.z_scores(db(s, d), 30).withColumn("z", F.round("z", 6)),
        Q("select a.key, a.i, round((a.v - quantile_cont(b.v, 0.5)) / (stddev_pop(b.v) + 1), 6) as z from db a join db b on a.key = b.key and b.i >= a.i - 30 and b.i < a.i + 30 group by a.key, a.i, a.v"),
    ),
    "smoothed": (
        lambda s, d: sr.smoothed(db(s, d), 5).withColumn("mean", F.round("mean", 6)),
        Q("select key, i, list_sort([v, coalesce(lag(v) over w, v), coalesce(lead(v) over w, v)])[2] as median3, round(avg(v) over (partition by key order by i range between 5 preceding and 5 following), 6) as mean from db window w as (partition by key order by i)"),
    ),
    "bars": (
        lambda s, d: sr.bars(db(s, d), 30),
        Q("select key, (p * least(n, 30) - 1) // n as bar, max(v) as peak, cast(sum(v) as bigint) as total, count(*) as n from (select key, v, row_number() over (partition by key order by i) as p, count(*) over (partition by key) as n from db) group by 1, 2".replace("count(*) as n from (select key, v", "count(*) as n from (select key, v").replace("group by 1, 2", "group by key, (p * least(n, 30) - 1) // n")),
    ),
    "music_score": (
        lambda s, d: sr.music_score(placed(s, d)).select("key", *(F.round(c, 6).alias(c) for c in ("active", "dips", "score"))),
        Q("""select key, round(case when l >= 100 then active else 0 end, 6) as active, round(case when l >= 100 and k >= 3 then dips else 0 end, 6) as dips,
          round(case when coalesce(l, 0) < 100 then 0 when coalesce(k, 0) < 3 then active else least(greatest((active - 0.6) / 0.3, 0), 1) * (1 - 0.6 * dips) end, 6) as score from (
          select key, any_value(l) as l, avg(case when v > top - 20 then 1 else 0 end) as active from placed join (select key, quantile_cont(v, 0.95) as top, count(*) as l from placed where v > -85 group by key) using (key) group by key) left join (
          select key, avg(x) as dips, count(*) as k from (select key, case when max(v) - min(v) >= 15 then 1 else 0 end as x from placed p where i < (select count(*) from placed q where q.key = p.key) // 100 * 100 group by key, i // 100) group by key) using (key)""", PLACED),
    ),
    "gated_loudness": (
        lambda s, d: sr.loudness(placed(s, d).select("key", "i", F.pow(F.lit(10.0), F.col("v") / 10).alias("power"))).withColumn("loudness", F.round("loudness", 4)),
        Q("""select k.key, round(x.l, 4) as loudness from (select distinct key from placed) k left join (select b.key, -0.691 + 10 * log10(avg(p) + 1e-20) as l from bl b join (select key, -0.691 + 10 * log10(avg(p) + 1e-20) - 10 as g from bl group by key) g on g.key = b.key and b.l > g.g group by b.key) x on x.key = k.key""",
          PLACED, "bl as (select key, p, -0.691 + 10 * log10(p + 1e-20) as l from (select key, avg(10.0 ** (v / 10)) over w as p, count(*) over w as n from placed window w as (partition by key order by i rows between current row and 3 following)) where n = 4 and -0.691 + 10 * log10(p + 1e-20) > -70)"),
    ),
    "loudness_range": (
        lambda s, d: sr.loudness_range(placed(s, d).select("key", "i", F.pow(F.lit(10.0), F.col("v") / 10).alias("power"))).withColumn("range", F.round("range", 4)),
        Q("""select k.key, round(case when count(l) > 1 then quantile_cont(l, 0.95) - quantile_cont(l, 0.1) else 0 end, 4) as range from (select distinct key from placed) k left join (
            select b.key, b.l from b3 b join (select key, -0.691 + 10 * log10(avg(10 ** ((l + 0.691) / 10))) - 20 as g from b3 group by key) g on g.key = b.key and b.l > g.g) x on x.key = k.key group by k.key""",
          PLACED, "b3 as (select key, -0.691 + 10 * log10(p + 1e-20) as l from (select key, avg(10.0 ** (v / 10)) over w as p, count(*) over w as n, row_number() over (partition by key order by i) - 1 as r from placed window w as (partition by key order by i rows between current row and 29 following)) where n = 30 and r % 10 = 0 and -0.691 + 10 * log10(p + 1e-20) > -70)"),
    ),
    "linear_levels": (
        lambda s, d: db(s, d).select("key", "i", F.round(tx.level(F.col("v").cast("double")), 9).alias("level")),
        Q("select key, i, round(10.0 ** (v / 20), 9) as level from db"),
    ),
    "composite_scores": (
        lambda s, d: spans(s, d).select("id", hl.composite_score(*(F.col("v") * k % 101 for k in (1, 3, 7, 11, 13))).alias("score")),
        f"with {SPANS} select id, cast(round_even(round(0.9 * (0.35 * (v % 101) + 0.2 * (v * 3 % 101) + 0.25 * (v * 7 % 101) + 0.1 * (v * 11 % 101)) / 0.9 + 0.1 * (v * 13 % 101), 9), 0) as int) as score from spans",
    ),
    "energy_spans": (
        lambda s, d: scores.energy_scores(placed(s, d), frame_spans(s, d), 50, 5),
        Q("""select s.key, s.id, case when n is null then 50 when count(vo.v) < 5 then 0 else cast(round_even(0.7 * least(greatest((quantile_cont(vo.v, 0.75) - med) / greatest(p95 - med, 1) * 100, 0), 100) + 0.3 * least(greatest(stddev_pop(vo.v) / 8 * 100, 0), 100), 0) as bigint) end as energy
          from (select key, i as id, i as t0, i + 20 + i % 40 as t1 from placed where i % 25 = 0) s left join st on st.key = s.key left join vo on vo.key = s.key and vo.i >= s.t0 and vo.i < s.t1 group by s.key, s.id, n, med, p95""",
          PLACED, otsu_sql("placed", "ot"), "vo as (select p.* from placed p join ot on ot.key = p.key and p.v >= ot.threshold)", "st as (select key, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.95) as p95, count(*) as n from vo group by key having count(*) >= 50)"),
    ),
    "silence_full_plan": (
        lambda s, d: silence.full_plan(placed(s, d).join(sr.otsu(placed(s, d)), "key"), spoken_at(s, d), guarded(s, d), scopes(s, d), 10, 4, 3, 5, 4, 8, 12),
        Q(f"select key, t0, t1 from (select key, -(-t0 // 4) * 4 as t0, t1 // 4 * 4 as t1 from (select key, cast(ceil(t0 / 4) * 4 as bigint) as t0, t1 from {minus('isc', 'ik')})) where t1 - t0 >= 12".replace("-(-t0 // 4) * 4 as t0", "t0"), SILENCE),
    ),
    "weighted_box": (
        lambda s, d: scores.weighted_box(spans(s, d).select("key", (F.col("v") % 97).alias("v"), F.col("v").alias("w"))).withColumn("centre", F.round("centre", 6)),
        f"""with {SPANS}, r as (select key, v, sum(w) over (partition by key order by v) as r, sum(w) over (partition by key) as t from (select key, v % 97 as v, sum(v) as w from spans group by all))
        select key, min(v) filter (100 * r >= 10 * t) as lo, min(v) filter (100 * r >= 90 * t) as hi, any_value(c) as centre from r join (select key, round(sum(v % 97 * v) / sum(v), 6) as c from spans group by key) using (key) group by key""",
    ),
    "distractors": (
        lambda s, d: scores.distractors(spans(s, d).select(F.lit(1).alias("key"), (F.col("key") % 60).alias("cell"), F.col("t0").alias("t")), DAY),
        f"with {SPANS} select 1 as key, cell from (select key % 60 as cell, count(*) as n, count(distinct t0 // {DAY}) as b from spans group by 1) where n >= 5 and b >= 3 and 100 * b >= 6 * (select count(distinct t0 // {DAY}) from spans)",
    ),
    "judges": (
        lambda s, d: scores.votes(table(s, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_partkey") % 3 != 0).alias("vote"))),
        "select key, n, yes, case when n >= 3 then yes >= 2 else n > 0 and yes = n end as decided from (select l_orderkey as key, count(*) filter (l_suppkey % 5 <> 0) as n, count(*) filter (l_suppkey % 5 <> 0 and l_partkey % 3 <> 0) as yes from lineitem where l_linenumber <= 3 group by 1)",
    ),
    "seeded_topk": (
        lambda s, d: rank.seeded_top(candidates(s, d), candidates(s, d).where("id % 9 = 0").select("key", "id", "t"), spans(s, d).groupBy("key").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")), 12 * HOUR, 6),
        pick_sql(
            f"select p.key, p.id, p.t0, cast(null as bigint) as t1, null as score, 0 as g, greatest({12 * 12 * HOUR}, e.b - e.a) as s from ({CAND}) p join ends e on e.key = p.key where p.id % 9 = 0 union all select p.key, p.id, p.t0, null, p.score, 1, greatest({12 * 12 * HOUR}, e.b - e.a) from ({CAND}) p join ends e on e.key = p.key where e.b - p.t0 >= {12 * HOUR}",
            "g, coalesce(score, 0) desc, t0, id", "len(w.kept) >= 6 or (c.g = 1 and len(list_filter(w.kept, lambda y: 12 * abs(y.t0 - c.t0) < c.s)) > 0)", "select key, x.id as id, x.t0 as t, x.score as score from kept", "ends as (select key, min(t0) as a, max(t1) as b from spans group by key)",
        ),
    ),
    "covered_budget": (
        lambda s, d: rank.covered_budget(candidates(s, d), 60 * HOUR, 2 * DAY, 3),
        pick_sql(CAND, "score desc, t0, id", f"coalesce(list_sum(list_transform(w.kept, lambda y: y.t1 - y.t0)), 0) + c.t1 - c.t0 > {60 * HOUR} or {CROWD}", "select key, x.id as id, x.t0 as t0, x.t1 as t1, x.score as score from kept"),
    ),
    "rate_limited": (
        lambda s, d: rank.rate_limited(candidates(s, d), 6 * HOUR, DAY, 2),
        pick_sql(CAND, "score desc, t0, id", f"len(list_filter(w.kept, lambda y: abs(y.t0 - c.t0) < {6 * HOUR})) > 0 or {DENSE}", "select key, x.id as id, x.t0 as t, x.score as score from kept"),
    ),
    "slots": (
        lambda s, d: rank.slots(candidates(s, d), DAY, HOUR, 5, 6 * HOUR),
        pick_sql(
            CAND.replace("kind from", "kind, v % 3 = 0 as busy from"), "score desc, t0, id",
            f"len(list_filter(w.kept, lambda y: not y.busy)) >= 5 or len(list_filter(w.kept, lambda y: not y.busy and (abs(y.t0 - c.t0) < {DAY} or (c.t0 < y.t1 + {HOUR} and y.t0 < c.t1 + {HOUR})))) > 0 or (c.busy and (len(list_filter(w.kept, lambda y: y.busy)) >= 3 or len(list_filter(w.kept, lambda y: y.busy and abs(y.t0 - c.t0) < {DAY})) > 0))",
            f"select key, x.id as id, x.t0 as t0, x.t1 as t1, x.score as score, not x.busy as taken from kept k where not x.busy or not exists (select 1 from kept j where j.key = k.key and not j.x.busy and k.x.t0 - {HOUR} < j.x.t1 and j.x.t0 < k.x.t1 + {HOUR})",
        ),
    ),
    "first_wins": (
        lambda s, d: rank.first_wins(candidates(s, d), 6 * HOUR),
        pick_sql(
            CAND, "score desc, t0, id", "len(list_filter(w.kept, lambda y: y.t0 < c.t1 and c.t0 < y.t1)) > 0",
            """, lost as (select c.key, c.id, c.kind, c.score, c.t0, arg_min(k.x.id, k.x.r) as winner from cand c join kept k on k.key = c.key and k.x.t0 < c.t1 and c.t0 < k.x.t1 where not exists (select 1 from kept j where j.key = c.key and j.x.id = c.id) group by all)
            select k.key, x.id as id, x.t0 as t0, x.t1 as t1, x.score as score, coalesce((select string_agg(kind, ',' order by l.score desc, l.t0, l.id) from lost l where l.key = k.key and l.winner = k.x.id), '') as also from kept k""",
        ),
    ),
    "first_list_wins": (
        lambda s, d: rank.first_list_wins(table(s, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("list"), F.col("event_id").alias("id"), (F.col("event_id") * 7 % 60).alias("i"), (F.col("event_id") % 4 + 1).alias("n"))),
        pick_sql("select user_id as key, event_id % 3 as list, event_id as id, event_id * 7 % 60 as i, event_id % 4 + 1 as n from events", "list, i, id", "len(list_filter(w.kept, lambda y: c.i < y.i + y.n and y.i < c.i + c.n)) > 0", "select key, x.list as list, x.id as id, x.i as i, x.n as n from kept"),
    ),
}
