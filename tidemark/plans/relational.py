"""Relational queries that Spark offers as they are: joins, grouping sets, set operations, percentiles, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.inputs import SPANS, micros, spans, table

MINUTES = 30


def pricing_summary(s, d):
    line = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2024-06-01").cast("timestamp_ntz"))
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"))


def nation_orders(s, d):
    """Orders per nation and status; the two dimension tables are five and twenty-five rows of fixed size."""
    dims = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    cust = table(s, d, "customer").join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(s, d, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def rolled(s, d, how):
    df = table(s, d, "events").withColumn("day", F.dayofmonth("ts"))
    return getattr(df, how)("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))


def sessions(s, d):
    """Spans grouped while less than half an hour lies between one's end and the next's start."""
    at = F.timestamp_micros("t0")
    length = F.concat(((F.col("t1") - F.col("t0")) / 1_000_000 + MINUTES * 60).cast("long").cast("string"), F.lit(" seconds"))
    grouped = spans(s, d).groupBy("key", F.session_window(at, length).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return grouped.select("key", "n", "t0", "t1")


GAP = MINUTES * 60_000_000
ALL = {
    "pricing_summary": (
        pricing_summary,
        "select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, cast(sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as bigint) as cents, count(*) as n from lineitem where l_shipdate <= timestamp '2024-06-01' group by all",
    ),
    "nation_orders": (
        nation_orders,
        "select r_name, n_name, o_orderstatus, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
    ),
    "rollup": (lambda s, d: rolled(s, d, "rollup"), "select event_type, cast(day as int) as day, count(*) as n, max(value) as peak from (select *, dayofmonth(ts) as day from events) group by rollup (event_type, day)"),
    "cube": (lambda s, d: rolled(s, d, "cube"), "select event_type, cast(day as int) as day, count(*) as n, max(value) as peak from (select *, dayofmonth(ts) as day from events) group by cube (event_type, day)"),
    "set_intersect": (
        lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))),
        "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    ),
    "set_except": (
        lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))),
        "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'O'",
    ),
    "full_outer": (
        lambda s, d: table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers")).join(table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers")), "k", "full"),
        "select k, customers, suppliers from (select c_nationkey as k, count(*) as customers from customer group by 1) full join (select s_nationkey as k, count(*) as suppliers from supplier group by 1) using (k)",
    ),
    "percentiles": (
        lambda s, d: table(s, d, "events").groupBy("event_type").agg(*(F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in (50, 75, 90, 95))),
        "select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.95) as p95 from events group by 1",
    ),
    "screen_share": (
        lambda s, d: spans(s, d).groupBy("kind").agg(F.sum(F.col("t1") - F.col("t0")).alias("time"), F.count(F.lit(1)).alias("shots"), F.min(F.col("t1") - F.col("t0")).alias("shortest")),
        f"with {SPANS} select kind, cast(sum(t1 - t0) as bigint) as time, count(*) as shots, min(t1 - t0) as shortest from spans group by kind",
    ),
    "majority_vote": (
        lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 15).alias("votes")).where(2 * F.col("votes") > F.col("n")),
        "select user_id, count(*) as n, count(*) filter (value > 15) as votes from events group by 1 having 2 * count(*) filter (value > 15) > count(*)",
    ),
    "sliding_counts": (
        lambda s, d: table(s, d, "events").groupBy(F.window(F.timestamp_micros(micros()), "7 hours", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start"), "event_type", "n"),
        "select start, event_type, count(*) as n from (select event_type, unnest([x, x - 21600000000]) as start, epoch_us(ts) as t from (select *, epoch_us(ts) // 21600000000 * 21600000000 as x from events)) where t < start + 25200000000 group by all",
    ),
    "gap_sessions": (
        sessions,
        f"""with {SPANS} select key, count(*) as n, min(t0) as t0, max(t1) as t1 from (
          select *, sum(case when e is null or t0 > e then 1 else 0 end) over (partition by key order by t0, w1, id rows unbounded preceding) as g from (
            select *, max(w1) over (partition by key order by t0, w1, id rows between unbounded preceding and 1 preceding) as e from (
              select key, id, t0, t1, t0 + ((t1 - t0) // 1000000) * 1000000 + {GAP} as w1 from spans))) group by key, g""",
    ),
}
