"""Scores of spans and points: weighted percentiles, energy, densest windows, pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.intervals import overlapping
from tidemark.operators.series import otsu


def weighted_percentile(df: DataFrame, percent: int) -> DataFrame:
    """(key, v): per key the smallest v at which the running weight w reaches ``percent`` of the total."""
    by_value = df.groupBy("key", "v").agg(F.sum("w").alias("w"))
    run = F.sum("w").over(Window.partitionBy("key").orderBy("v"))
    total = F.sum("w").over(Window.partitionBy("key"))
    return by_value.select("key", "v", (100 * run >= percent * total).alias("_ok")).where("_ok").groupBy("key").agg(F.min("v").alias("v"))


def energy(df: DataFrame) -> DataFrame:
    """(key, median, p90, spread): linear percentiles and their distance, the parts of an energy score."""
    q = lambda p: F.percentile("v", F.lit(p))
    return df.groupBy("key").agg(q(0.5).alias("median"), q(0.9).alias("p90"), (q(0.9) - q(0.5)).alias("spread"))


def densest(points: DataFrame, width: int, step: int) -> DataFrame:
    """(key, start, n): of windows of ``width`` that start at multiples of ``step``, the one with most points; the first of equals.

    A point is counted in the windows that can hold it, so nothing is joined.
    """
    last = F.floor(F.col("t") / step)
    first = F.floor((F.col("t") - width) / step) + 1
    counts = points.select("key", F.explode(F.sequence(first, last)).alias("w")).groupBy("key", "w").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("key").agg(F.max(F.struct("n", (-F.col("w")).alias("minus"))).alias("m"))
    return best.select("key", (-F.col("m.minus") * step).alias("start"), F.col("m.n").alias("n"))


def pauses(points: DataFrame, cap: int) -> DataFrame:
    """(key, id, pause, strength): time since the point before, and its share of ``cap`` in percent, whole."""
    before = F.lag("t").over(Window.partitionBy("key").orderBy("t", "id"))
    pause = F.col("t") - before
    return points.select("key", "id", pause.alias("pause")).withColumn("strength", F.floor(100 * F.least("pause", F.lit(cap)) / cap))


def energy_scores(frames: DataFrame, spans: DataFrame, enough: int = 50, least: int = 20) -> DataFrame:
    """(key, id, energy): 0 to 100 for spans (key, id, t0, t1 in frames), 0.7 loudness and 0.3 dynamics of voiced frames.

    Loudness is the 75th percentile against the key's voiced median, scaled to its 95th; dynamics the population
    deviation over 8 dB.  Voiced: at or above the key's Otsu valley.  50 for keys with fewer than ``enough`` voiced
    frames, 0 for spans with fewer than ``least``.
    """
    voiced = frames.join(otsu(frames), "key").where("v >= threshold").select("key", "i", "v")
    q = lambda p: F.percentile("v", F.lit(p))
    stats = voiced.groupBy("key").agg(q(0.5).alias("med"), q(0.95).alias("p95"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
    inside = overlapping(spans.select("key", "id", "t0", "t1"), voiced.select("key", F.col("i").alias("t0"), (F.col("i") + 1).alias("t1"), "v"), 256, "b")
    own = inside.select("key", "id", F.col("b_v").alias("v")).groupBy("key", "id").agg(q(0.75).alias("p75"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("k"))
    rows = spans.select("key", "id").join(stats, "key", "left").join(own, ["key", "id"], "left")
    share = lambda c: F.least(F.greatest(c * 100, F.lit(0.0)), F.lit(100.0))
    loud = share((F.col("p75") - F.col("med")) / F.greatest(F.col("p95") - F.col("med"), F.lit(1.0)))
    score = F.bround(0.7 * loud + 0.3 * share(F.col("std") / 8)).cast("long")
    return rows.select("key", "id", F.when(F.col("n").isNull(), 50).when(F.coalesce("k", F.lit(0)) < least, 0).otherwise(score).alias("energy"))


def weighted_box(df: DataFrame, low: int = 10, high: int = 90) -> DataFrame:
    """(key, lo, hi, centre): where the running weight of values (key, v, w) reaches ``low`` and ``high`` percent, and the mean."""
    centre = df.groupBy("key").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("centre"))
    side = lambda p, name: weighted_percentile(df, p).withColumnRenamed("v", name)
    return side(low, "lo").join(side(high, "hi"), "key").join(centre, "key")


def distractors(events: DataFrame, bins: int, times: int = 5, least: int = 3, percent: int = 6) -> DataFrame:
    """(key, cell): cells with ``times`` events (key, cell, t) or more, spread over ``least`` and ``percent`` % of the
    key's used bins of ``bins`` time units."""
    rows = events.withColumn("_bin", F.floor(F.col("t") / bins))
    used = rows.groupBy("key").agg(F.count_distinct("_bin").alias("_used"))
    cells = rows.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_bin").alias("_bins"))
    return cells.join(used, "key").where((F.col("_n") >= times) & (F.col("_bins") >= least) & (100 * F.col("_bins") >= percent * F.col("_used"))).select("key", "cell")


def votes(judged: DataFrame, judges: int = 3, need: int = 2) -> DataFrame:
    """(key, n, yes, decided): votes (key, vote), null for a judge without an answer; ``need`` of ``judges`` decide, or
    all that answered when they are fewer; nothing is decided without an answer."""
    by = judged.groupBy("key").agg(F.count("vote").alias("n"), F.count_if("vote").alias("yes"))
    enough = F.when(F.col("n") >= judges, F.col("yes") >= need).otherwise((F.col("n") > 0) & (F.col("yes") == F.col("n")))
    return by.select("key", "n", "yes", enough.alias("decided"))
