"""Queries over sampled series, and constrained ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import rank, review
from tidemark.operators import series as sr
from tidemark.plans.inputs import HOUR, SERIES, SPANS, merged, points, series, spans

on = lambda: F.col("v") >= 1000
Q = lambda body: f"with {SERIES} {body}"
S = lambda body: f"with {SPANS} {body}"


def runs_sql(where: str, gap: int, tail: str = "") -> str:
    return Q(f"""select key, min(i) as i0, max(i) + 1 as i1 from (select *, sum(n) over (partition by key order by i) as g from (
      select *, case when coalesce(i - lag(i) over (partition by key order by i) > {1 + gap}, true) then 1 else 0 end as n from series where {where})) group by key, g {tail}""")


def greedy_sql(candidates: str, order: str, clash: str, columns: str) -> str:
    """Candidates taken in order unless they clash with one taken before, by recursion over a key's rank."""
    return f"""with recursive {SPANS}, cand as (select *, row_number() over (partition by key order by {order}) as r from ({candidates})),
      walk as (
        select key, 1 as r, [struct_pack(id := id, t0 := t0, t1 := t1, score := score)] as kept from cand where r = 1
        union all
        select w.key, c.r, case when len(list_filter(w.kept, lambda y: {clash})) > 0 then w.kept else list_append(w.kept, struct_pack(id := c.id, t0 := c.t0, t1 := c.t1, score := c.score)) end
        from walk w join cand c on c.key = w.key and c.r = w.r + 1)
      select key, {columns} from (select key, unnest(kept) as x from walk qualify r = max(r) over (partition by key))"""


CAND = "select key, id, t0, t1, v as score from spans where t0 < t1"


def candidates(s, d):
    return spans(s, d).where("t0 < t1").select("key", "id", F.col("t0").alias("t"), "t0", "t1", F.col("v").alias("score"))


def labelled(s, d):
    return series(s, d).withColumn("label", F.when(F.col("v") >= 2000, "high").when(F.col("v") >= 500, "mid").otherwise("low"))


def items(s, d):
    return spans(s, d).select("key", F.col("id").alias("n"), "t0", "t1", "kind", (F.col("v") % 2 == 0).alias("on"))


ITEMS = "items as (select key, id as n, t0, t1, kind, v % 2 = 0 as \"on\" from spans)"
IDS = """ids as (select key, n, t0, t1, kind, substr(kind, 1, 1) || cast(t0 // 10000 as varchar)
  || case when p > 1 then '-' || cast(p as varchar) else '' end as id from (
  select *, row_number() over (partition by key, substr(kind, 1, 1), t0 // 10000 order by t0, t1, n) as p from items))"""
PAGES = "pages as (select key, id as n, t0, t1 from spans)"

ALL = {
    "runs": (lambda s, d: sr.runs(series(s, d), on()), runs_sql("v >= 1000", 0)),
    "runs_bridged": (lambda s, d: sr.runs(series(s, d), on(), max_gap=3, least=4), runs_sql("v >= 1000", 3, "having max(i) + 1 - min(i) >= 4")),
    "hysteresis_gate": (lambda s, d: sr.gate(series(s, d), 500, 2000), runs_sql("v >= 500", 0, "having max(v) >= 2000")),
    "rle": (
        lambda s, d: sr.rle(labelled(s, d), "label"),
        Q("""select key, any_value(label) as label, min(i) as i0, max(i) + 1 as i1 from (select *, sum(n) over (partition by key order by i) as g from (
          select *, case when coalesce(lag(label) over (partition by key order by i) <> label, true) then 1 else 0 end as n from (
          select *, case when v >= 2000 then 'high' when v >= 500 then 'mid' else 'low' end as label from series))) group by key, g"""),
    ),
    "dilate": (
        lambda s, d: sr.dilate(series(s, d), on(), 3),
        Q("select key, i, max(cast(v >= 1000 as int)) over (partition by key order by i rows between 3 preceding and 3 following) as flag from series"),
    ),
    "moving_max_prefix_sum": (
        lambda s, d: sr.around(series(s, d), 5),
        Q("select key, i, v, max(v) over (partition by key order by i rows between 5 preceding and 5 following) as moving_max, cast(sum(v) over (partition by key order by i) as bigint) as prefix_sum from series"),
    ),
    "deviation_range": (
        lambda s, d: sr.deviation(series(s, d), 30),
        Q("select a.key, a.i, a.v - quantile_cont(b.v, 0.5) as deviation from series a join series b on a.key = b.key and b.i >= a.i - 30 and b.i < a.i + 30 group by a.key, a.i, a.v"),
    ),
    "downsample_max": (
        lambda s, d: sr.downsample(series(s, d), 36),
        Q("select key, i // 36 as bin, max(v) as peak, cast(sum(v) as bigint) as total, count(*) as n from series group by 1, 2"),
    ),
    "quietest": (
        lambda s, d: sr.quietest(series(s, d), 4),
        Q("select key, i, min(struct_pack(v := v, i := i)) over (partition by key order by i rows between 4 preceding and 4 following).i as at from series"),
    ),
    "spaced_topk": (
        lambda s, d: rank.spaced_top(candidates(s, d), 24 * HOUR, 5).select("key", "id", "t", "score"),
        greedy_sql(CAND, "score desc, t0, id", f"len(w.kept) >= 5 or abs(y.t0 - c.t0) < {24 * HOUR}", "x.id as id, x.t0 as t, x.score as score"),
    ),
    "nms": (
        lambda s, d: rank.suppressed(candidates(s, d)),
        greedy_sql(CAND, "score desc, t0, id", "100 * (least(y.t1, c.t1) - greatest(y.t0, c.t0)) > 25 * least(y.t1 - y.t0, c.t1 - c.t0) or 10 * (least(y.t1, c.t1) - greatest(y.t0, c.t0)) >= 3 * (greatest(y.t1, c.t1) - least(y.t0, c.t0))", "x.id as id, x.t0 as t0, x.t1 as t1, x.score as score"),
    ),
    "merge_close": (
        lambda s, d: rank.merge_close(candidates(s, d), 6 * HOUR),
        greedy_sql(CAND, "t0, id", f"c.t0 - y.t0 < {6 * HOUR}", "x.id as id, x.t0 as t"),
    ),
    "budget_pick": (lambda s, d: rank.budgeted(candidates(s, d), 48 * HOUR, 3), greedy_sql(CAND, "t0, id", f"len(list_filter(w.kept, lambda z: c.t0 - z.t0 < {48 * HOUR})) >= 3", "x.id as id, x.t0 as t")),
    "topk_per_group": (
        lambda s, d: rank.top_per_group(candidates(s, d), [F.desc("score"), F.col("id")], 5).select("key", "id", "score", "place"),
        S(f"select * from (select key, id, score, row_number() over (partition by key order by score desc, id) as place from ({CAND})) where place <= 5"),
    ),
    "review_ids": (lambda s, d: review.with_ids(items(s, d)), S(f"select * from ids").replace("select * from ids", "").rstrip() + f", {ITEMS}, {IDS} select * from ids"),
    "review_violations": (
        lambda s, d: review.violations(items(s, d).withColumn("id", F.concat("kind", (F.col("n") % 50).cast("string")))),
        S("") .rstrip() + f", {ITEMS} select key, n, 'duplicate id' as problem from items qualify count(*) over (partition by key, kind || cast(n % 50 as varchar)) > 1",
    ),
    "carry_over": (
        lambda s, d: review.carried(items(s, d).select("key", F.col("n").alias("id"), "on"), items(s, d).where("n % 3 = 0").select("key", F.col("n").alias("id"), (~F.col("on")).alias("on"), (F.col("n") % 2 == 0).alias("touched"))),
        S("").rstrip() + f", {ITEMS} select key, n as id, case when n % 6 = 0 then not \"on\" else \"on\" end as \"on\", n % 6 = 0 as touched from items",
    ),
    "review_summary": (
        lambda s, d: review.summary(items(s, d)),
        S("").rstrip() + f", {ITEMS}, o as (select * from items where \"on\"), m as {merged('o')} select i.key, count(*) as n, count(*) filter (\"on\") as n_on, coalesce((select cast(sum(t1 - t0) as bigint) from m where m.key = i.key), 0) as covered from items i group by i.key",
    ),
    "retime_pages": (
        lambda s, d: review.retimed(items(s, d), 60_000_000, 600_000_000),
        S("").rstrip() + f", {PAGES} select key, n, t0, least(greatest(t1 + 60000000, t0 + 600000000), coalesce(lead(t0) over (partition by key order by t0, n), 9000000000000000000)) as t1 from pages",
    ),
}
