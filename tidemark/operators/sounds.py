"""Sounds and words claimed by one another: islands under words, detections of several kinds, words heard again, cursor rests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import norm, ratio
from tidemark.operators import rank
from tidemark.operators.intervals import overlapping


def claimed(words: DataFrame, islands: DataFrame, bucket: int = 60_000, edge: int = 20, share: int = 60, gap: int = 120) -> DataFrame:
    """(key, id, island): which islands of sound (key, id, t0, t1, held) a word (key, id, t0, t1, need) really sits on.

    A word's start may be stretched back over a pause, so it claims islands from its end backwards: always the last one,
    then each earlier one unless more than ``gap`` of silence lies between and it has ``share`` percent of the length it needs
    or the island is a held sound (``held``, more than half of it).  There it stops.  An island counts when it reaches more than
    ``edge`` into the word.  One fold for each word, over the islands under it.
    """
    under = overlapping(words.select("key", "id", "t0", "t1", "need"), islands.select("key", "id", "t0", "t1", "held"), bucket)
    under = under.where((F.col("b_t1") > F.col("t0") + edge) & (F.col("b_t0") < F.col("t1") - edge))
    one = F.struct((-F.col("b_t0")).alias("o"), F.col("b_id").alias("id"), F.col("b_t0").alias("a"), F.col("b_t1").alias("b"), F.coalesce("b_held", F.lit(False)).alias("held"), (F.least("b_t1", "t1") - F.greatest("b_t0", "t0")).alias("n"))
    lists = under.groupBy("key", "id", "need").agg(F.sort_array(F.collect_list(one)).alias("l"))
    kind = "array<" + islands.schema["id"].dataType.simpleString() + ">"
    start = F.struct(F.array().cast(kind).alias("mine"), F.lit(0).cast("long").alias("got"), F.lit(None).cast("long").alias("from"), F.lit(False).alias("done"))

    def step(acc, x):
        enough = (100 * acc["got"] >= share * F.col("need")) | x["held"]
        stop = acc["done"] | F.coalesce(enough & (acc["from"] - x["b"] > gap), F.lit(False))
        taken = F.struct(F.array_append(acc["mine"], x["id"]).alias("mine"), (acc["got"] + x["n"]).alias("got"), x["a"].alias("from"), F.lit(False).alias("done"))
        return F.when(stop, F.struct(acc["mine"].alias("mine"), acc["got"].alias("got"), acc["from"].alias("from"), F.lit(True).alias("done"))).otherwise(taken)

    return lists.select("key", "id", F.explode(F.aggregate("l", start, step)["mine"]).alias("island"))


def merged_by_rank(found: DataFrame, bucket: int, sure: int = 30, bonus: int = 5, most: int = 97) -> DataFrame:
    """Detections (key, id, t0, t1, sub, rank, conf) without overlaps: (key, id, t0, t1, sub, conf, sources).

    The lowest rank stays, of one rank the surest, then the smallest id.  Each other kind that hears the same sound is
    listed in ``sources``, in that order, and when it is ``sure`` raises the confidence to the higher of both and ``bonus``, ``most`` at most.  A
    detection that overlaps several counts for the first of them.
    """
    order = [F.col("rank"), -F.col("conf"), F.col("id")]
    free = lambda kept, x: F.forall(kept, lambda y: (x["t1"] <= y["t0"]) | (x["t0"] >= y["t1"]))
    own = ["id", "t0", "t1", "sub", "rank", "conf"]
    kept = rank.chosen(rank.isles(found, "t0", "t1", 1), order, free, own, by=("key", "_isle"))
    lost = found.select("key", *own).join(kept.select("key", "id"), ["key", "id"], "left_anti")
    first = F.min(F.struct("b_rank", (-F.col("b_conf")).alias("c"), "b_id"))
    to = overlapping(lost, kept, bucket).groupBy("key", "id", "sub", "rank", "conf").agg(first.alias("m"))
    lists = to.groupBy("key", F.col("m.b_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", (-F.col("conf")).alias("c"), F.col("id").alias("i"), "sub"))).alias("l"))
    rows = kept.join(lists, ["key", "id"], "left")

    def add(acc, x):
        raised = F.least(F.lit(most), F.greatest(acc["conf"], -x["c"]) + bonus)
        more = F.struct(F.array_append(acc["sources"], x["sub"]).alias("sources"), F.when(-x["c"] >= sure, raised).otherwise(acc["conf"]).cast("int").alias("conf"))
        return F.when(F.array_contains(acc["sources"], x["sub"]), acc).otherwise(more)

    start = F.struct(F.array("sub").alias("sources"), F.col("conf").cast("int").alias("conf"))
    out = rows.withColumn("_x", F.when(F.col("l").isNull(), start).otherwise(F.aggregate("l", start, add)))
    return out.select("key", "id", "t0", "t1", "sub", "_x.conf", F.array_join("_x.sources", ",").alias("sources"))


def heard_again(new: DataFrame, rows: DataFrame, reach: int = 1000, alike: float = 0.75, bucket: int = 60_000) -> DataFrame:
    """New words (key, id, text, t0, t1) with ``again``: whether a word (key, text, t0, t1) within ``reach`` of it is alike, by the
    matching blocks of their letters.  Words without letters are always heard again.  Only neighbours in time are compared."""
    wide = new.select("key", "id", norm(F.col("text")).alias("w"), (F.col("t0") - reach).alias("t0"), (F.col("t1") + reach + 1).alias("t1"))
    near = overlapping(wide.where("w != ''"), rows.select("key", norm(F.col("text")).alias("w"), "t0", (F.col("t1") + 1).alias("t1")), bucket, "ab")
    pairs = near.select("key", "id", "w", "b_w").distinct()
    hits = pairs.where(ratio(F.col("w"), F.col("b_w")) >= alike).select("key", "id").distinct().withColumn("_hit", F.lit(True))
    return new.join(hits, ["key", "id"], "left").withColumn("again", F.coalesce("_hit", F.coalesce(norm(F.col("text")), F.lit("")) == "")).drop("_hit")


def cursor_rests(samples: DataFrame, still: int = 600, longest: int = 2000, least: float = 0.04) -> DataFrame:
    """(key, t, x, y): samples at which a cursor that has stopped on something rests, and where.

    Samples (key, t, page, x, y, detail, zone): ``page`` marks a change of the whole page, x and y the cursor where it moved,
    ``detail`` how much there is around it, ``zone`` that it is in a place to ignore.  A cursor rests from ``still`` to ``longest`` after its last move, until
    it moves again or the page changes, if there was detail of ``least`` and no zone.  One ordered pass per key.
    """
    line = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col("page"), F.struct("t", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")))
    good = (F.coalesce("detail", F.lit(1.0)) >= least) & ~F.coalesce("zone", F.lit(False))
    at = F.struct("t", F.when(good, F.col("x").cast("double")).alias("x"), F.when(good, F.col("y").cast("double")).alias("y"))
    event = event.when(F.col("x").isNotNull(), at)
    rows = samples.withColumn("_e", event).withColumn("_last", F.last("_e", ignorenulls=True).over(line)).where("_e is null and _last.x is not null")
    rest = F.col("t") - F.col("_last.t")
    return rows.where((rest >= still) & (rest <= longest)).select("key", "t", F.col("_last.x").alias("x"), F.col("_last.y").alias("y"))
