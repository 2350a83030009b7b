"""Interval algebra on tables (key, t0, t1) of half-open BIGINT intervals; one sequence per key.

Every operator drops intervals that are empty, reversed or have a null key or end, and returns sorted-disjoint
("normal") intervals unless it says otherwise.  All are one shuffle by key plus windows, or a bucketed join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of the buckets of range joins, in the unit of t0 and t1: six hours of microseconds.
BUCKET = 6 * 3600 * 1_000_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides, whatever size Spark guesses.

    Its guess starts from the bytes of compressed files and does not grow where rows are exploded into words, frames or cells, so
    a large table can look small enough for a broadcast, which passes through the driver's memory.
    """
    return df.hint("merge")


def proper(df: DataFrame) -> DataFrame:
    return df.where("key is not null and t0 < t1")


def islands(df: DataFrame, gap: int | None = None) -> DataFrame:
    """Merge intervals that overlap or touch; with ``gap`` also those less than ``gap`` apart."""
    order = Window.partitionBy("key").orderBy("t0", "t1")
    before = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("t0") - F.col("_end")
    new = F.col("_end").isNull() | ((apart > 0) if gap is None else ((apart > 0) & (apart >= gap)))
    marked = proper(df).select("key", "t0", "t1").withColumn("_end", before)
    return marked.withColumn("_i", F.sum(new.cast("int")).over(order)).groupBy("key", "_i").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("_i")


#: Cells of a coarser level hold this many of the finer one; three levels span all of BIGINT.
COARSER, LEVELS = 256, 3
#: Roles of a cell in a join: both intervals at home in its level, only the left one, only the right one.
BOTH, LEFT, RIGHT = 0, 1, 2


def _cells(t0: str, t1: str, bucket: int, long: bool, own: int | None, copy: int | None) -> Column:
    """The (level, cell, role) structs of an interval, whose level goes by its length (0 unless ``long``).

    At its level it stands with the role BOTH and, in coarse levels, ``own``; above it with the role ``copy``.
    """
    length = F.col(t1).cast("double") - F.col(t0)
    level = F.when(length < bucket * COARSER, 0).when(length < bucket * COARSER**2, 1).otherwise(2) if long else F.lit(0)
    none = F.array().cast("array<struct<level:int,cell:bigint,role:int>>")

    def at(n: int, role: int) -> Column:
        first, last = F.floor(F.col(t0) / (bucket * COARSER**n)), F.floor((F.col(t1) - 1) / (bucket * COARSER**n))
        return F.transform(F.sequence(first, last), lambda c: F.struct(F.lit(n).alias("level"), c.alias("cell"), F.lit(role).alias("role")))

    parts = []
    for n in range(LEVELS):
        if n == 0 or long:
            parts.append(F.when(level == n, F.concat(at(n, BOTH), at(n, own)) if n and own is not None else at(n, BOTH)).otherwise(none))
        if n and copy is not None:
            parts.append(F.when(level < n, at(n, copy)).otherwise(none))
    return F.concat(*parts)


def overlapping(a: DataFrame, b: DataFrame, bucket: int, short: str = "") -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` (its columns renamed b_*) with equal keys and overlapping intervals.

    Both sides are cut into cells of ``bucket`` units, some times the usual length, and joined by key and cell, so a long
    key is spread over many tasks.  A long interval stands in cells of a coarser level only, so no row has many cells; a
    short one also leaves a copy in the coarse cell it lies in, which meets long intervals and never another copy.
    A pair is formed in the cell where its overlap begins, so none appears twice.  ``short`` names the sides ("a", "b", "ab")
    whose intervals stay under 256 buckets; the other side then leaves no copies.  It never changes the pairs.
    """
    wide_a, wide_b = "a" not in short, "b" not in short
    ca = _cells("t0", "t1", bucket, wide_a, LEFT if wide_a else None, RIGHT if wide_b else None)
    cb = _cells("b_t0", "b_t1", bucket, wide_b, RIGHT if wide_b else None, LEFT if wide_a else None)
    flat = lambda df, p: df.withColumns({f"_{p}{f}": F.col(f"_{p}.{f}") for f in ("level", "cell", "role")}).drop(f"_{p}")
    left = flat(proper(a).withColumn("_x", F.explode(ca)), "x")
    right = flat(proper(b).select(*(F.col(c).alias(f"b_{c}") for c in b.columns)).withColumn("_y", F.explode(cb)), "y")
    on = (F.col("key") == F.col("b_key")) & (F.col("_xcell") == F.col("_ycell")) & (F.col("_xlevel") == F.col("_ylevel")) & (F.col("_xrole") == F.col("_yrole"))
    size = F.lit(bucket) * F.pow(F.lit(COARSER), F.col("_xlevel")) if wide_a or wide_b else F.lit(bucket)
    meet = (F.col("t0") < F.col("b_t1")) & (F.col("b_t0") < F.col("t1")) & (F.col("_xcell") == F.floor(F.greatest("t0", "b_t0") / size))
    return left.join(right, on & meet).drop(*(f"_{p}{f}" for p in "xy" for f in ("level", "cell", "role")))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return islands(a.select("key", "t0", "t1").unionByName(b.select("key", "t0", "t1")))


def intersect(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    return overlapping(islands(a), islands(b), bucket).select("key", F.greatest("t0", "b_t0").alias("t0"), F.least("t1", "b_t1").alias("t1"))


def subtract(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """What of ``a`` no interval of ``b`` covers: the gaps between b's pieces inside each interval of ``a``.

    ``bucket`` is the width of the join's cells, in the unit of t0 and t1: some times the usual length.
    """
    whole = islands(a)
    cuts = overlapping(whole, islands(b), bucket).select("key", "t0", "t1", "b_t0", "b_t1")
    edges = cuts.unionByName(whole.select("key", "t0", "t1", F.col("t1").alias("b_t0"), F.col("t1").alias("b_t1")))
    before = F.lag("b_t1").over(Window.partitionBy("key", "t0").orderBy("b_t0", "b_t1"))
    gaps = edges.select("key", F.coalesce(before, F.col("t0")).alias("g0"), F.col("b_t0").alias("g1"))
    return gaps.where("g0 < g1").select("key", F.col("g0").alias("t0"), F.col("g1").alias("t1"))


def clamp(df: DataFrame, lo: Column | int, hi: Column | int) -> DataFrame:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return islands(df.select("key", F.greatest("t0", lo).alias("t0"), F.least("t1", hi).alias("t1")))


def invert(df: DataFrame, scope: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The parts of ``scope`` (key, t0, t1) that ``df`` leaves free; keys without intervals keep their whole scope."""
    return subtract(scope, df, bucket)


def pad(df: DataFrame, before: int, after: int, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Move starts earlier and ends later (negative: shrink), clamp, then merge; vanished intervals go."""
    t0, t1 = F.col("t0") - before, F.col("t1") + after
    t0 = t0 if lo is None else F.greatest(t0, F.lit(lo))
    t1 = t1 if hi is None else F.least(t1, F.lit(hi))
    return islands(proper(df).select("key", t0.alias("t0"), t1.alias("t1")))


def drop_short(df: DataFrame, least: int) -> DataFrame:
    return islands(df).where(F.col("t1") - F.col("t0") >= least)


def total(df: DataFrame) -> DataFrame:
    """(key, n, covered): number and length of the merged intervals."""
    return islands(df).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t1") - F.col("t0")).alias("covered"))


def frames(df: DataFrame, per_frame: int, mode: str) -> DataFrame:
    """Intervals as frame numbers: inner (ceil, floor), outer (floor, ceil) or nearest (half up); empty ones go."""
    down = lambda c: F.floor(F.col(c) / per_frame)
    up = lambda c: -F.floor(-F.col(c) / per_frame)
    near = lambda c: F.floor((2 * F.col(c) + per_frame) / (2 * per_frame))
    start, end = {"inner": (up, down), "outer": (down, up), "nearest": (near, near)}[mode]
    return islands(proper(df).select("key", start("t0").cast("long").alias("t0"), end("t1").cast("long").alias("t1")))


def ripple(points: DataFrame, removed: DataFrame) -> DataFrame:
    """Points (key, id, t) moved to ``t_new``: t less what is removed before it; inside a removed interval its start."""
    order = Window.partitionBy("key").orderBy("t0")
    cut = islands(removed).withColumn("_before", F.coalesce(F.sum(F.col("t1") - F.col("t0")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marks = cut.select("key", F.col("t0").alias("t"), F.lit(None).cast("long").alias("id"), F.struct("t0", "t1", "_before").alias("_cut"), F.lit(0).alias("_k"))
    rows = points.select("key", "t", "id", F.lit(None).cast(marks.schema["_cut"].dataType).alias("_cut"), F.lit(1).alias("_k"))
    line = Window.partitionBy("key").orderBy("t", "_k", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("_last", F.last("_cut", ignorenulls=True).over(line)).where("_k = 1")
    gone = F.coalesce(F.col("_last._before") + F.least("t", "_last.t1") - F.col("_last.t0"), F.lit(0))
    return both.select("key", "id", "t", (F.col("t") - gone).alias("t_new"))


def butt_layout(keep: DataFrame) -> DataFrame:
    """Kept intervals laid end to end: (key, start, src_in, src_out)."""
    order = Window.partitionBy("key").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("t1") - F.col("t0")).over(order), F.lit(0))
    return islands(keep).select("key", start.alias("start"), F.col("t0").alias("src_in"), F.col("t1").alias("src_out"))


def shares(points: DataFrame, spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Left-semi stab: the points (key, t, ...) that some interval of ``spans`` contains (start in, end out).

    The merged spans are disjoint, so a point has one partner at most.
    """
    stabs = overlapping(points.withColumns({"t0": F.col("t"), "t1": F.col("t") + 1}), islands(spans), bucket, "a")
    return stabs.select(*points.columns)


def overlap_length(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, covered): the time that both cover, 0 where they do not meet; keys of either side."""
    both = intersect(a, b, bucket).groupBy("key").agg(F.sum(F.col("t1") - F.col("t0")).alias("_n"))
    keys = proper(a).select("key").union(proper(b).select("key")).distinct()
    return keys.join(both, "key", "left").select("key", F.coalesce("_n", F.lit(0)).alias("covered"))


def snap_edges(df: DataFrame, move: Callable[[Column], Column]) -> DataFrame:
    """Both edges moved by ``move``; intervals that vanish go, the others are merged."""
    return islands(proper(df).select("key", move(F.col("t0")).alias("t0"), move(F.col("t1")).alias("t1")))


def kept_and_removed(keep: DataFrame, scope: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, t0, t1, kept): the scope cut into what is kept and what is removed; either list gives the other."""
    kept = intersect(keep, scope, bucket).withColumn("kept", F.lit(True))
    return kept.unionByName(subtract(scope, keep, bucket).withColumn("kept", F.lit(False)))


def split_items(items: DataFrame, removed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Items (key, id, t0, t1, src_in) cut by removed intervals and closed up: (key, id, part, t0, t1, src_in, src_out).

    Each part that stays moves left by what is removed before it; an item that lies in a removed interval goes.
    """
    cut = islands(removed)
    order = Window.partitionBy("key").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    upto = cut.withColumn("_gone", F.sum(F.col("t1") - F.col("t0")).over(order))
    hits = overlapping(items, upto, bucket).select("key", "id", "t0", "t1", "src_in", F.col("b_t0").alias("c0"), F.col("b_t1").alias("c1"), F.col("b__gone").alias("gone"))
    starts = items.where("t0 < t1").select("key", "id", F.col("t0").alias("t"))
    marks = upto.select("key", F.col("t0").alias("t"), F.struct("t0", "t1", "_gone").alias("_cut"))
    line = Window.partitionBy("key").orderBy("t", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = starts.select("*", F.lit(None).cast(marks.schema["_cut"].dataType).alias("_cut")).unionByName(marks.select("key", F.lit(None).cast("long").alias("id"), "t", "_cut"))
    before = both.withColumn("_last", F.last("_cut", ignorenulls=True).over(line)).where("id is not null")
    # what is removed before an item's start: all of the last cut at or before it if it has ended, else up to its own start
    gone = F.when(F.col("_last.t1") <= F.col("t"), F.col("_last._gone")).otherwise(F.col("_last._gone") - (F.col("_last.t1") - F.col("_last.t0")))
    own = items.where("t0 < t1").join(before.select("key", "id", F.coalesce(gone, F.lit(0)).alias("gone")), ["key", "id"])
    edges = hits.unionByName(own.select("key", "id", "t0", "t1", "src_in", F.lit(None).cast("long").alias("c0"), F.col("t0").alias("c1"), "gone"))
    # a part runs from a cut's end (or the item's start) to the next cut's start
    each = Window.partitionBy("key", "id").orderBy(F.asc_nulls_first("c0"), "c1")
    end = F.coalesce(F.lead("c0").over(each), F.col("t1"))
    parts = edges.select("key", "id", "t0", "src_in", "gone", F.greatest("c1", "t0").alias("a"), F.least(end, "t1").alias("b")).where("a < b")
    part = F.row_number().over(Window.partitionBy("key", "id").orderBy("a")) - 1
    return parts.select(
        "key", "id", part.alias("part"), (F.col("a") - F.col("gone")).alias("t0"), (F.col("b") - F.col("gone")).alias("t1"),
        (F.col("src_in") + F.col("a") - F.col("t0")).alias("src_in"), (F.col("src_in") + F.col("b") - F.col("t0")).alias("src_out"),
    )
