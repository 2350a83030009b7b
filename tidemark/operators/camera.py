"""Zooms and crops: activity of samples, visible cuts, zooms by rhythm of speech, camera states between keys, crop anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.intervals import overlapping
from tidemark.operators.joins import snap_nearest


def activity_weight(boxes: DataFrame, least: int = 10, percent: int = 10, cursor: float = 0.3) -> DataFrame:
    """(key, t, weight, x0, y0, x1, y1) per sample of boxes (key, t, x, y, w, h, px, cursor, ignored).

    Boxes under ``least`` pixels count only for the cursor; those under ``percent`` of the largest are noise.  Ignored
    boxes take part in that comparison and are dropped then.  The weight is the root of the pixels, the cursor's at
    ``cursor`` of its own; a sample without boxes left weighs 0 and has no frame.
    """
    counts = (F.col("px") >= least) | F.col("cursor")
    top = F.max(F.when(counts, F.col("px"))).over(Window.partitionBy("key", "t"))
    kept = counts & (100 * F.col("px") >= percent * F.col("_top")) & ~F.col("ignored")
    rows = boxes.withColumn("_top", top).withColumn("_kept", F.coalesce(kept, F.lit(False)))
    of = lambda c: F.when(F.col("_kept"), c)
    root = lambda on: F.sqrt(F.coalesce(F.sum(F.when(F.col("_kept") & on, F.col("px"))), F.lit(0)))
    return rows.groupBy("key", "t").agg(
        (root(~F.col("cursor")) + cursor * root(F.col("cursor"))).alias("weight"),
        F.min(of(F.col("x"))).alias("x0"), F.min(of(F.col("y"))).alias("y0"), F.max(of(F.col("x") + F.col("w"))).alias("x1"), F.max(of(F.col("y") + F.col("h"))).alias("y1"),
    )


def visible_cuts(clips: DataFrame, slack: int) -> DataFrame:
    """(key, t): starts of the clips that do not go on where the one before ended, on the sequence or in its media.

    ``slack`` is half a frame, in time.
    """
    line = Window.partitionBy("key").orderBy("t0", "id")
    before = {c: F.lag(c).over(line) for c in ("t1", "media", "src_out")}
    rows = clips.select("key", "t0", "media", "src_in", *(v.alias(f"p_{c}") for c, v in before.items()))
    jump = (F.col("media") != F.col("p_media")) | (F.abs(F.col("src_in") - F.col("p_src_out")) > 4 * slack) | (F.col("t0") - F.col("p_t1") > 3 * slack)
    return rows.where(jump).select("key", F.col("t0").alias("t")).distinct()


def rhythm(
    sentences: DataFrame, cuts: DataFrame, hard: DataFrame, jump: bool = True, back: int = 300, ahead: int = 50, pause: int = 80, early: int = 40, settle: int = 500, least: int = 800, after: int = 300
) -> DataFrame:
    """Zooms (key, n, t0, t1, ending) on every second sentence (key, n from 0, t0, t1); the first stays wide.

    Both ends go to a cut (key, t) near them, else into a pause longer than ``pause``: its middle, or ``early`` before
    the speech for eased zooms.  A hard cut more than ``settle`` inside ends the zoom; those under ``least`` are dropped.
    """
    line = Window.partitionBy("key").orderBy("n")
    rows = sentences.select("key", "n", "t0", "t1", F.lag("t1").over(line).alias("p"), F.coalesce(F.lead("t0").over(line), F.col("t1") + after).alias("next")).where("n % 2 = 1")
    ends = rows.select("key", F.explode(F.array(F.struct((2 * F.col("n")).alias("id"), F.col("t0").alias("t")), F.struct((2 * F.col("n") + 1).alias("id"), F.col("next").alias("t")))).alias("e")).select("key", "e.*")
    snapped = snap_nearest(ends, cuts.select("key", "t").distinct(), back, ahead, 60_000).withColumn("n", F.floor(F.col("id") / 2))
    side = lambda i: F.max(F.when(F.col("id") % 2 == i, F.col("t_new")))
    rows = rows.join(snapped.groupBy("key", "n").agg(side(0).alias("a"), side(1).alias("b")), ["key", "n"])
    half = lambda x, y: F.floor((x + y) / 2).cast("long")
    start = half(F.col("p"), F.col("t0")) if jump else F.col("t0") - early
    a = F.when((F.col("a") == F.col("t0")) & (F.col("t0") - F.col("p") > pause), start).otherwise(F.col("a"))
    b = F.when((F.col("b") == F.col("next")) & (F.col("next") - F.col("t1") > pause), half(F.col("t1"), F.col("next"))).otherwise(F.col("b"))
    zooms = rows.select("key", "n", a.alias("a"), b.alias("b"))
    inside = overlapping(zooms.select("key", "n", (F.col("a") + settle + 1).alias("t0"), F.col("b").alias("t1")), hard.select("key", F.col("t").alias("t0"), (F.col("t") + 1).alias("t1")), 60_000, "b")
    first = inside.groupBy("key", "n").agg(F.min("b_t0").alias("h"))
    out = zooms.join(first, ["key", "n"], "left").select("key", "n", F.col("a").alias("t0"), F.coalesce("h", "b").alias("t1"), F.when(F.col("h").isNotNull() | F.lit(jump), "cut").otherwise("ease").alias("ending"))
    return out.where(F.col("t1") - F.col("t0") >= least)


def eased(u: Column, kind: Column) -> Column:
    """The eased share of a move at the share ``u`` of its time: smooth, out, in, back (overshoots), else even."""
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
    d = u - 1.0
    return (
        F.when(kind == "smooth", u * u * (3.0 - 2.0 * u))
        .when(kind == "out", 1.0 + d * d * d)
        .when(kind == "in", u * u * u)
        .when(kind == "back", 1.0 + 2.2 * d * d * d + 1.2 * d * d)
        .otherwise(u)
    )


def camera_states(points: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id, t, s, cx, cy): the camera at points (key, id, t) between its keys (key, n, t, s, cx, cy, ease).

    Scale and offset share one eased move; before the first key and after the last they stand still, and a scale of 1
    or more keeps the frame inside the picture.  One ordered pass per key; points of keys without a camera key are null.
    """
    line = Window.partitionBy("key").orderBy("t", "n")
    state = F.struct("t", "s", "cx", "cy", "ease")
    own = keys.withColumn("_a", state).withColumn("_b", F.lead("_a").over(line)).withColumn("_first", F.row_number().over(line) == 1)
    shape = "struct<t:bigint,s:double,cx:double,cy:double,ease:string>"
    rows = own.select("key", "t", "n", F.lit(0).alias("_k"), F.lit(None).cast("bigint").alias("id"), F.struct("_a", "_b").cast(f"struct<_a:{shape},_b:{shape}>").alias("_m"), F.when(F.col("_first"), F.col("_a")).cast(shape).alias("_f"))
    rows = rows.unionByName(points.select("key", "t", F.lit(0).cast("long").alias("n"), F.lit(1).alias("_k"), "id", F.lit(None).cast(f"struct<_a:{shape},_b:{shape}>").alias("_m"), F.lit(None).cast(shape).alias("_f")))
    at = Window.partitionBy("key").orderBy("t", "_k", "n", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_m", F.last("_m", ignorenulls=True).over(at)).withColumn("_f", F.max("_f").over(Window.partitionBy("key"))).where("_k = 1")
    a, b, f = (lambda c, s=s: F.col(f"{s}.{c}") for s in ("_m._a", "_m._b", "_f"))
    u = F.when(b("t") > a("t"), (F.col("t") - a("t")) / (b("t") - a("t"))).otherwise(1.0)
    rows = rows.withColumn("_e", eased(u, b("ease")))
    scale = a("s") + (b("s") - a("s")) * F.col("_e")
    offset = lambda c: (0.5 - a(c)) * a("s") + ((0.5 - b(c)) * b("s") - (0.5 - a(c)) * a("s")) * F.col("_e")
    middle = lambda c: F.when(scale >= 1.0, F.least(F.greatest(0.5 - offset(c) / scale, 0.5 / scale), 1.0 - 0.5 / scale)).otherwise(0.5 - offset(c) / scale)
    pick = lambda c, moving: F.when(F.col("t") <= f("t"), f(c)).when(b("t").isNull(), a(c)).otherwise(moving)
    return rows.select("key", "id", "t", pick("s", scale).alias("s"), pick("cx", middle("cx")).alias("cx"), pick("cy", middle("cy")).alias("cy"))


def anchors(shots: DataFrame, reach: int, mode: str = "auto") -> DataFrame:
    """(key, n, x, y, anchor): the crop centre of shots (key, n, s0, media, face_x, face_y, face_h, focus_x, focus_y).

    The face, a little higher (not in the mode ``activity``); else the activity; else, but in the mode ``face``, the last
    anchor found in the same media within ``reach`` of source time; else the centre.  Shots without media are centred.
    """
    has = F.col("media").isNotNull()
    face = has & F.col("face_x").isNotNull() & F.lit(mode in ("auto", "face"))
    found = F.when(face, F.struct("s0", F.col("face_x").alias("x"), F.least(F.lit(1.0), F.col("face_y") + 0.25 * F.col("face_h")).alias("y"), F.lit("face").alias("anchor"))).when(
        has & F.col("focus_x").isNotNull(), F.struct("s0", F.col("focus_x").alias("x"), F.col("focus_y").alias("y"), F.lit("activity").alias("anchor"))
    )
    line = Window.partitionBy("key", "media").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = shots.withColumn("_f", found).withColumn("_old", F.last("_f", ignorenulls=True).over(line))
    near = has & F.lit(mode != "face") & (F.abs(F.col("s0") - F.col("_old.s0")) < reach)
    pick = lambda c, rest: F.when(F.col("_f").isNotNull(), F.col(f"_f.{c}")).when(near, F.lit("hold") if c == "anchor" else F.col(f"_old.{c}")).otherwise(F.lit(rest))
    return rows.select("key", "n", pick("x", 0.5).alias("x"), pick("y", 0.5).alias("y"), pick("anchor", "center").alias("anchor"))


def shot_stats(shots: DataFrame, by: str, slack: int) -> DataFrame:
    """Shots, their time, and those that repeat the value of the shot they touch, per key and value of ``by``."""
    line = Window.partitionBy("key").orderBy("t0", "t1", "n")
    again = (F.lag(by).over(line) == F.col(by)) & (F.abs(F.lag("t1").over(line) - F.col("t0")) < slack)
    rows = shots.withColumn("_again", F.coalesce(again, F.lit(False)))
    return rows.groupBy("key", by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t1") - F.col("t0")).alias("time"), F.count_if("_again").alias("repeats"))
