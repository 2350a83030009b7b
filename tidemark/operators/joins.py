"""Joins of timelines: midpoint, stabbing with priority, as-of, nearest in a window, ordered context.

``bucket`` is the width of a join's cells in the tables' unit (see ``overlapping``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.intervals import overlapping


def midpoint_join(words: DataFrame, clips: DataFrame, bucket: int) -> DataFrame:
    """Words (key, id, t0, t1) in the clips (key, id, t0, t1) that hold their midpoint, edges clamped to the clip."""
    pairs = overlapping(words, clips, bucket)
    mid2 = F.col("t0") + F.col("t1")
    pairs = pairs.where((2 * F.col("b_t0") <= mid2) & (mid2 < 2 * F.col("b_t1")))
    return pairs.select("key", "id", F.col("b_id").alias("clip"), F.greatest("t0", "b_t0").alias("t0"), F.least("t1", "b_t1").alias("t1"))


def overlap_join(words: DataFrame, clips: DataFrame, bucket: int) -> DataFrame:
    """Words in every clip they overlap, clamped; ``mid`` says whether the clip holds the midpoint."""
    mid2 = F.col("t0") + F.col("t1")
    mid = (2 * F.col("b_t0") <= mid2) & (mid2 < 2 * F.col("b_t1"))
    return overlapping(words, clips, bucket).select(
        "key", "id", F.col("b_id").alias("clip"), F.greatest("t0", "b_t0").alias("t0"), F.least("t1", "b_t1").alias("t1"), mid.alias("mid")
    )


def stab_top(points: DataFrame, clips: DataFrame, bucket: int, highest: bool = True) -> DataFrame:
    """For each point (key, id, t) the clip (key, id, t0, t1, track) on the highest or lowest track that contains it."""
    hits = overlapping(points.select("key", "id", F.col("t").alias("t0"), (F.col("t") + 1).alias("t1")), clips, bucket, "a")
    rank = F.struct(F.col("b_track") if highest else -F.col("b_track"), (-F.col("b_id")).alias("i"))
    best = hits.groupBy("key", "id").agg(F.max(F.struct(rank.alias("r"), F.col("b_id").alias("clip"), F.col("b_track").alias("track"))).alias("m"))
    return best.select("key", "id", "m.clip", "m.track")


def asof_last(points: DataFrame, marks: DataFrame) -> DataFrame:
    """For each point (key, id, t) the last mark (key, id, t) at or before it: by one ordered pass per key, no range join."""
    rows = points.select("key", "t", "id", F.lit(None).cast("struct<t:bigint,id:bigint>").alias("_m"), F.lit(1).alias("_k"))
    rows = rows.unionByName(marks.select("key", "t", "id", F.struct("t", "id").alias("_m"), F.lit(0).alias("_k")))
    line = Window.partitionBy("key").orderBy("t", "_k", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_last", F.last("_m", ignorenulls=True).over(line)).where("_k = 1").select("key", "id", "t", F.col("_last.t").alias("mark_t"), F.col("_last.id").alias("mark_id"))


def snap_nearest(points: DataFrame, marks: DataFrame, back: int, ahead: int, bucket: int) -> DataFrame:
    """Each point's t moved to the nearest mark in [t - back, t + ahead] (ties: the earlier), else left as it is."""
    window = points.select("key", "id", "t", (F.col("t") - back).alias("t0"), (F.col("t") + ahead + 1).alias("t1"))
    near = overlapping(window, marks.select("key", F.col("t").alias("t0"), (F.col("t") + 1).alias("t1")), bucket, "ab")
    best = near.groupBy("key", "id").agg(F.min(F.struct(F.abs(F.col("b_t0") - F.col("t")).alias("d"), F.col("b_t0").alias("to"))).alias("m"))
    out = points.join(best.select(F.col("key").alias("_k"), F.col("id").alias("_i"), "m.to"), (F.col("key") == F.col("_k")) & (F.col("id") == F.col("_i")), "left")
    return out.select("key", "id", "t", F.coalesce("to", "t").alias("t_new"))


def context_words(words: DataFrame, n: int = 3) -> DataFrame:
    """Words (key, pos, token) with the ``n`` before and after them, joined by spaces."""
    line = Window.partitionBy("key").orderBy("pos")
    side = lambda a, b: F.array_join(F.collect_list("token").over(line.rowsBetween(a, b)), " ")
    return words.select("key", "pos", "token", side(-n, -1).alias("before"), side(1, n).alias("after"))
