"""Sampled signals (key, i, v): frames in order, one series per key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.intervals import shuffled


def line():
    return Window.partitionBy("key").orderBy("i")


def sounding_runs(df: DataFrame) -> DataFrame:
    """(key, t0, t1): runs of the frames (key, i), each given once or more, end exclusive; a run is cut where 64 frames end.

    Frames are packed into the bits of a number for each 64, before and after one shuffle; the runs are then read off the bits of many
    numbers at a time.
    """
    bit = F.expr("shiftleft(1L, cast(pmod(i, 64) as int))")
    packed = df.where("key is not null and i is not null").groupBy("key", F.floor(F.col("i") / 64).cast("long").alias("b")).agg(F.bit_or(bit).alias("m"))

    def read(batches):
        for batch in batches:
            bits = np.unpackbits(batch["m"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
            edge = np.diff(bits, axis=1, prepend=np.int8(0), append=np.int8(0))
            row, start = np.nonzero(edge > 0)
            at = batch["b"].to_numpy()[row] * 64
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(row)), pa.array(at + start), pa.array(at + np.nonzero(edge < 0)[1])], names=["key", "t0", "t1"])

    return packed.mapInArrow(read, f"key {df.schema['key'].dataType.simpleString()}, t0 long, t1 long")


def runs(df: DataFrame, on: Column, max_gap: int = 0, least: int = 1) -> DataFrame:
    """(key, i0, i1): runs of frames where ``on`` holds, end exclusive; gaps of up to ``max_gap`` frames are bridged."""
    hits = df.where(on).select("key", "i")
    new = F.coalesce(F.col("i") - F.lag("i").over(line()) > 1 + max_gap, F.lit(True))
    cut = hits.withColumn("_new", new).withColumn("_r", F.sum(F.col("_new").cast("int")).over(line()))
    out = cut.groupBy("key", "_r").agg(F.min("i").alias("i0"), (F.max("i") + 1).alias("i1")).drop("_r")
    return out.where(F.col("i1") - F.col("i0") >= least)


def gate(df: DataFrame, soft: float, hard: float) -> DataFrame:
    """Hysteresis: runs of frames at or above ``soft`` that hold a frame at or above ``hard``."""
    hits = df.where(F.col("v") >= soft).select("key", "i", "v")
    new = F.coalesce(F.col("i") - F.lag("i").over(line()) > 1, F.lit(True))
    cut = hits.withColumn("_new", new).withColumn("_r", F.sum(F.col("_new").cast("int")).over(line()))
    out = cut.groupBy("key", "_r").agg(F.min("i").alias("i0"), (F.max("i") + 1).alias("i1"), F.max("v").alias("peak"))
    return out.where(F.col("peak") >= hard).select("key", "i0", "i1")


def rle(df: DataFrame, label: str) -> DataFrame:
    """(key, label, i0, i1): run-length encoding of a label column, by place in the series."""
    change = F.coalesce(F.lag(label).over(line()) != F.col(label), F.lit(True))
    cut = df.withColumn("_new", change).withColumn("_r", F.sum(F.col("_new").cast("int")).over(line()))
    return cut.groupBy("key", "_r").agg(F.first(label).alias("label"), F.min("i").alias("i0"), (F.max("i") + 1).alias("i1")).drop("_r")


def around(df: DataFrame, k: int) -> DataFrame:
    """Moving maximum over k frames to both sides, and the prefix sum of ``v``."""
    near, up = line().rowsBetween(-k, k), line().rowsBetween(Window.unboundedPreceding, 0)
    return df.select("key", "i", "v", F.max("v").over(near).alias("moving_max"), F.sum("v").over(up).alias("prefix_sum"))


def dilate(df: DataFrame, on: Column, k: int) -> DataFrame:
    """``flag``: whether ``on`` holds within k rows."""
    return df.select("key", "i", F.max(on.cast("int")).over(line().rowsBetween(-k, k)).alias("flag"))


def deviation(df: DataFrame, reach: int) -> DataFrame:
    """Distance of v from the median of the frames in [i - reach, i + reach), in whole units."""
    near = Window.partitionBy("key").orderBy("i").rangeBetween(-reach, reach - 1)
    return df.select("key", "i", (F.col("v") - F.percentile("v", F.lit(0.5)).over(near)).alias("deviation"))


def downsample(df: DataFrame, width: int) -> DataFrame:
    """Maximum, sum and number of frames in bins of ``width``."""
    return df.groupBy("key", F.floor(F.col("i") / width).alias("bin")).agg(F.max("v").alias("peak"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def quietest(df: DataFrame, k: int) -> DataFrame:
    """For every frame the lowest frame within k rows, the earliest of equals."""
    return df.select("key", "i", F.min(F.struct("v", "i")).over(line().rowsBetween(-k, k)).alias("_m")).select("key", "i", F.col("_m.i").alias("at"))


def otsu(df: DataFrame, lo: int = -100, hi: int = 0) -> DataFrame:
    """(key, threshold): the valley of a level histogram of whole units, levels clipped to [lo, hi).

    The threshold is the middle of the plateau, empty bins included, around the lowest split with the most
    between-class variance (those within a thousandth of it that touch it).  A key whose levels share one bin has no
    split: its threshold is its 10th percentile (linear) plus 20, -20 at most.  Whole-number sums, so no rounding;
    the histogram, not the frames, is what the windows run over.
    """
    clipped = F.least(F.greatest("v", F.lit(lo)), F.lit(hi))
    binned = df.select("key", clipped.alias("v"), F.least(F.floor(clipped), F.lit(hi - 1)).cast("long").alias("b"))
    hist = binned.groupBy("key", "b").agg(F.count(F.lit(1)).alias("n"))
    up, all_ = Window.partitionBy("key").orderBy("b"), Window.partitionBy("key")
    sums = {"w0": F.sum("n").over(up), "m0": F.sum(F.col("n") * F.col("b")).over(up), "w": F.sum("n").over(all_), "m": F.sum(F.col("n") * F.col("b")).over(all_), "nb": F.lead("b").over(up)}
    h = hist.select("key", "b", *(c.alias(k) for k, c in sums.items())).where("w0 < w")
    spread = (F.col("m") * F.col("w0") - F.col("m0") * F.col("w")).cast("double") ** 2 / (F.col("w0") * (F.col("w") - F.col("w0")))
    h = h.select("key", "b", "nb", spread.alias("s")).withColumn("top", F.max("s").over(all_))
    peak = F.min(F.when(F.col("s") == F.col("top"), F.col("b"))).over(all_)
    h = h.withColumn("peak", peak).withColumn("low", (F.col("s") < F.col("top") * 0.999).cast("int")).withColumn("run", F.sum("low").over(up))
    # rows of a run after its first low one are within the limit; the peak's run is the plateau
    own = F.max(F.when(F.col("b") == F.col("peak"), F.col("run"))).over(all_)
    flat = h.withColumn("own", own).where("low = 0 and run = own").groupBy("key").agg(((F.min("b") + F.max("nb")) / 2).alias("t"))
    single = binned.groupBy("key").agg(F.least(F.percentile("v", F.lit(0.1)) + 20, F.lit(-20)).alias("alone"))
    return single.join(shuffled(flat), "key", "left").select("key", F.coalesce("t", "alone").alias("threshold"))


def gated(df: DataFrame, hyst: float) -> DataFrame:
    """Frames (key, i, v, threshold) with ``on``: in a run at or above threshold - ``hyst`` that holds one at or above the threshold."""
    soft = F.col("v") >= F.col("threshold") - hyst
    step = soft & F.coalesce(F.lag(soft).over(line()), F.lit(False)) & (F.col("i") - F.lag("i").over(line()) == 1)
    rows = df.withColumn("_soft", soft).withColumn("_r", F.sum((~step).cast("int")).over(line()))
    loud = F.max(F.when(F.col("v") >= F.col("threshold"), 1)).over(Window.partitionBy("key", "_r")).isNotNull()
    return rows.withColumn("on", F.col("_soft") & loud).drop("_soft", "_r")


def frame_owner(df: DataFrame, lead: float, smooth: int, floor: float, priority: DataFrame | None = None, enough: int = 100, otherwise: float = -50.0, hyst: float = 4.0) -> DataFrame:
    """(key, i, owner) of frames (key, mic, i, v): the microphones of recordings.

    A moving maximum over ``smooth`` frames to both sides bridges syllables; each microphone is gated by its own Otsu
    valley (``otherwise`` with fewer than ``enough`` frames above ``floor``).  The owner is on and ``lead`` above all
    others; with several on and no owner it is the one with the highest ``priority`` (rank > 0) if that is unique,
    else 'cross'; one on is 'unknown', none 'silent'.  Two windows by microphone and one aggregation by frame of a recording;
    ``priority`` is (mic, rank) for all recordings.
    """
    df = df.select(F.struct("key", F.col("mic").cast("string").alias("mic")).alias("key"), "i", "v")
    near = line().rowsBetween(-smooth, smooth)
    level = df.select("key", "i", F.max("v").over(near).alias("v"))
    signal = level.where(F.col("v") > floor + 0.5)
    counts = signal.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    limits = otsu(signal).join(counts, "key").select("key", F.when(F.col("_n") >= enough, F.col("threshold")).otherwise(otherwise).alias("threshold"))
    rows = gated(level.join(limits, "key", "left").withColumn("threshold", F.coalesce("threshold", F.lit(otherwise))), hyst)
    rows = rows.withColumn("rank", F.lit(0)) if priority is None else rows.join(priority.select(F.col("mic").cast("string").alias("_mic"), "rank"), F.col("key.mic") == F.col("_mic"), "left").drop("_mic").withColumn("rank", F.coalesce("rank", F.lit(0)))
    mic = F.struct((-F.col("v")).alias("d"), F.col("key.mic").alias("k"), "on")
    ranked = F.struct((-F.col("rank")).alias("d"), F.col("key.mic").alias("k"))
    by = rows.groupBy(F.col("key.key").alias("key"), "i").agg(F.sort_array(F.collect_list(mic)).alias("t"), F.sort_array(F.collect_list(F.when(F.col("on"), ranked))).alias("p"), F.count_if("on").alias("n"))
    first, second, p = F.col("t")[0], F.try_element_at("t", F.lit(2)), F.col("p")
    clear = first["on"] & (second.isNull() | (second["d"] - first["d"] >= lead))
    single = (p[0]["d"] < 0) & (F.try_element_at("p", F.lit(2)).isNull() | (F.try_element_at("p", F.lit(2))["d"] > p[0]["d"]))
    name = F.when(clear, first["k"]).when((F.col("n") >= 2) & single, p[0]["k"]).when(F.col("n") >= 2, "cross").when(F.col("n") == 1, "unknown").otherwise("silent")
    return by.select("key", "i", name.alias("owner"))


def lanes(owners: DataFrame, bridge: int, least: int, least_cross: int) -> DataFrame:
    """(key, lane, i0, i1): when each owner of ``frame_owner`` speaks in a recording, gaps under ``bridge`` frames closed."""
    rows = owners.where(~F.col("owner").isin("unknown", "silent")).select(F.struct("key", "owner").alias("key"), "i")
    spans = runs(rows, F.lit(True), bridge - 1).select("key.key", F.col("key.owner").alias("lane"), "i0", "i1")
    return spans.where(F.col("i1") - F.col("i0") >= F.when(F.col("lane") == "cross", least_cross).otherwise(least))


def z_scores(df: DataFrame, reach: int) -> DataFrame:
    """Distance of v from the median of the frames in [i - reach, i + reach), over their population deviation plus 1."""
    near = Window.partitionBy("key").orderBy("i").rangeBetween(-reach, reach - 1)
    return df.select("key", "i", ((F.col("v") - F.percentile("v", F.lit(0.5)).over(near)) / (F.stddev_pop("v").over(near) + 1)).alias("z"))


def smoothed(df: DataFrame, reach: int) -> DataFrame:
    """Median of three rows, the ends repeated, and the mean of the frames within ``reach``."""
    v, before, after = F.col("v"), F.coalesce(F.lag("v").over(line()), F.col("v")), F.coalesce(F.lead("v").over(line()), F.col("v"))
    median = F.greatest(F.least(v, before), F.least(v, after), F.least(before, after))
    return df.select("key", "i", median.alias("median3"), F.avg("v").over(line().rangeBetween(-reach, reach)).alias("mean"))


def bars(df: DataFrame, most: int) -> DataFrame:
    """(key, bar, peak, total, n): the frames of a key pooled into at most ``most`` bars of nearly equal numbers of frames."""
    place, size = F.row_number().over(line()), F.count(F.lit(1)).over(Window.partitionBy("key"))
    rows = df.select("key", "v", place.alias("p"), size.alias("n"))
    wanted = F.least(F.col("n"), F.lit(most))
    bar = F.floor((F.col("p") * wanted - 1) / F.col("n")).cast("long")
    return rows.groupBy("key", bar.alias("bar")).agg(F.max("v").alias("peak"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def music_score(df: DataFrame, live: float = -85.0, window: int = 100, enough: int = 100) -> DataFrame:
    """(key, active, dips, score) of frames (key, i, v in dB), i from 0: how much a signal is like music, 0 to 1.

    ``active`` is the share of frames within 20 dB of the 95th percentile of live ones, ``dips`` the share of whole
    windows that hold a dip of 15 dB.  Under ``enough`` live frames all is 0; under three windows the score is ``active``.
    """
    stats = df.where(F.col("v") > live).groupBy("key").agg(F.percentile("v", F.lit(0.95)).alias("top"), F.count(F.lit(1)).alias("_live"))
    size = df.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    rows = df.join(stats, "key", "left").join(size, "key")
    act = rows.groupBy("key", "_live", "_n").agg(F.avg((F.col("v") > F.col("top") - 20).cast("int")).alias("active"))
    whole = rows.where(F.col("i") < F.floor(F.col("_n") / window) * window).groupBy("key", F.floor(F.col("i") / window).alias("_w")).agg((F.max("v") - F.min("v") >= 15).cast("int").alias("_d"))
    dips = whole.groupBy("key").agg(F.avg("_d").alias("dips"), F.count(F.lit(1)).alias("_k"))
    out = act.join(dips, "key", "left")
    enough_live, three = F.coalesce(F.col("_live") >= enough, F.lit(False)), F.coalesce(F.col("_k") >= 3, F.lit(False))
    score = F.least(F.greatest((F.col("active") - 0.6) / 0.3, F.lit(0.0)), F.lit(1.0)) * (1 - 0.6 * F.col("dips"))
    return out.select(
        "key", F.when(enough_live, F.col("active")).otherwise(0.0).alias("active"), F.when(enough_live & three, F.col("dips")).otherwise(0.0).alias("dips"),
        F.when(~enough_live, 0.0).when(~three, F.col("active")).otherwise(score).alias("score"),
    )


def loudness(df: DataFrame, offset: float = -0.691) -> DataFrame:
    """(key, loudness): gated mean level of blocks (key, i, power) of 100 ms: means of four in a row, those over -70 dB,
    of these the ones within 10 dB of their mean; null where nothing passes."""
    four = F.avg("power").over(line().rowsBetween(0, 3))
    size = F.count(F.lit(1)).over(line().rowsBetween(0, 3))
    db = lambda c: offset + 10 * F.log10(c + 1e-20)
    blocks = df.select("key", four.alias("p"), size.alias("_n")).where("_n = 4").withColumn("l", db(F.col("p"))).where("l > -70")
    gate_ = blocks.groupBy("key").agg((db(F.avg("p")) - 10).alias("g"))
    loud = blocks.join(gate_, "key").where("l > g").groupBy("key").agg(db(F.avg("p")).alias("loudness"))
    return df.select("key").distinct().join(loud, "key", "left")


def loudness_range(df: DataFrame, offset: float = -0.691, gate_db: float = 20.0) -> DataFrame:
    """(key, range): how far loud and soft passages of blocks (key, i, power) of 100 ms lie apart, in decibels.

    Means of thirty blocks in a row from every tenth on; of those over -70 dB the ones within ``gate_db`` of their mean power count: the
    95th percentile less the 10th, linear.  0 under two of them.
    """
    long = line().rowsBetween(0, 29)
    rows = df.select("key", F.avg("power").over(long).alias("p"), F.count(F.lit(1)).over(long).alias("_n"), (F.row_number().over(line()) - 1).alias("_r"))
    blocks = rows.where("_n = 30 and _r % 10 = 0").withColumn("l", offset + 10 * F.log10(F.col("p") + 1e-20)).where("l > -70")
    mean = blocks.groupBy("key").agg((offset + 10 * F.log10(F.avg(F.pow(F.lit(10.0), (F.col("l") - offset) / 10))) - gate_db).alias("g"))
    kept = blocks.join(mean, "key").where("l > g").groupBy("key").agg((F.percentile("l", F.lit(0.95)) - F.percentile("l", F.lit(0.1))).alias("r"), F.count(F.lit(1)).alias("n"))
    return df.select("key").distinct().join(kept, "key", "left").select("key", F.when(F.col("n") > 1, F.col("r")).otherwise(0.0).alias("range"))
