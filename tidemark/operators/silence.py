"""The silence plan: which quiet stretches of a signal are cut, built from the series and interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals, series

#: Width of the cells of interval joins on frames.
FRAMES = 1024


def spans_of(runs: DataFrame) -> DataFrame:
    return runs.select("key", F.col("i0").alias("t0"), F.col("i1").alias("t1"))


def plan(frames: DataFrame, scope: DataFrame, soft: float, hard: float, bridge: int, talk: int, before: int, after: int, least: int) -> DataFrame:
    """Cuts (key, t0, t1) in frames: ``scope`` less the gated runs, bridged, long enough and padded; cuts of ``least`` or more stay."""
    loud = intervals.islands(spans_of(series.gate(frames, soft, hard)), bridge)
    voice = intervals.pad(loud.where(F.col("t1") - F.col("t0") >= talk), before, after)
    return intervals.subtract(scope, voice, FRAMES).where(F.col("t1") - F.col("t0") >= least)


def holes(frames: DataFrame, words: DataFrame, level: float, bridge: int, least: int) -> DataFrame:
    """Voiced stretches (key, t0, t1) of ``least`` frames or more that no word (key, t0, t1) covers, small gaps bridged."""
    voiced = spans_of(series.runs(frames, F.col("v") >= level))
    return intervals.islands(intervals.subtract(voiced, words, FRAMES), bridge).where(F.col("t1") - F.col("t0") >= least)


def full_plan(
    frames: DataFrame, words: DataFrame, protect: DataFrame, scope: DataFrame, hop: int, per_frame: int, pause: int, talk: int, before: int, after: int, least: int,
    hyst: float = 4.0, below: float = 6.0, widen: int = 3,
) -> DataFrame:
    """Cuts (key, t0, t1) of a timeline, in time units.

    ``frames`` is (key, i, v, threshold), frames of ``hop`` units without gaps; ``words`` and ``protect`` are (key, t0, t1).
    Sound is what the hysteresis gate opens, and what is forced: frames under a word that are at most ``below`` under the
    threshold, widened by ``widen`` frames, and protected spans.  Runs of sound closer than ``pause`` frames are one; runs
    under ``talk`` frames go unless a forced frame is in them.  What padded runs leave of the scope is cut, inward to
    video frames of ``per_frame`` units, where ``least`` is left.
    """
    inside = lambda spans: spans.select("key", F.floor(F.col("t0") / hop).cast("long").alias("t0"), (F.floor(F.col("t1") / hop) + 1).cast("long").alias("t1"))
    gate = series.gated(frames, hyst).where("on").select("key", F.col("i").alias("t0"), (F.col("i") + 1).alias("t1"))
    heard = frames.where(F.col("v") >= F.col("threshold") - below).select("key", F.col("i").alias("t0"), (F.col("i") + 1).alias("t1"))
    grid = frames.groupBy("key").agg(F.min("i").alias("t0"), (F.max("i") + 1).alias("t1"))
    guarded = intervals.pad(intervals.intersect(heard, inside(words), FRAMES), widen, widen)
    forced = intervals.intersect(intervals.union(guarded, inside(protect)), grid, FRAMES)
    runs = intervals.islands(gate.unionByName(forced), pause)
    held = intervals.overlapping(runs, forced, FRAMES).select("key", "t0", "t1").distinct()
    kept = runs.where(F.col("t1") - F.col("t0") >= talk).unionByName(held).distinct()
    padded = kept.select("key", (F.col("t0") * hop - before).alias("t0"), (F.col("t1") * hop + after).alias("t1"))
    cuts = intervals.subtract(scope, padded, FRAMES * hop)
    start = -F.floor(-F.col("t0") / per_frame) * per_frame
    end = F.floor(F.col("t1") / per_frame) * per_frame
    return cuts.select("key", start.cast("long").alias("t0"), end.cast("long").alias("t1")).where(F.col("t1") - F.col("t0") >= least)
