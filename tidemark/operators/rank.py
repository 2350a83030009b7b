"""Constrained ranking: choices that depend on what was chosen before, as folds over ordered candidates.

Where a choice reaches no further than a known distance, a key is first cut into isles that cannot affect each other and
each isle is folded alone; only limits on a whole key (top-k, slots, a budget of time) need all its candidates in one
fold.  The folds are Spark's own higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.intervals import overlapping


def isles(df: DataFrame, t0: str, t1: str, reach: int) -> DataFrame:
    """``df`` with _isle: a row starts a new one where it begins ``reach`` or more after all rows before it have ended."""
    line = Window.partitionBy("key").orderBy(t0, t1)
    before = F.max(F.greatest(t0, t1)).over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(t0) - before >= reach).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("_isle", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chosen(
    df: DataFrame, order: list[Column], allowed: Callable[[Column, Column], Column], columns: list[str], most: int | None = None, by: tuple[str, ...] = ("key",)
) -> DataFrame:
    """Candidates taken in ``order`` whenever ``allowed(kept, candidate)`` holds; ``most`` limits them (top-k).  One fold for each ``by``."""
    rank = F.struct(*(c.alias(f"o{j}") for j, c in enumerate(order)))
    seen = F.sort_array(F.collect_list(F.struct(rank.alias("o"), F.struct(*columns).alias("x"))))
    kind = f"array<{df.select(F.struct(*columns).alias('x')).schema['x'].dataType.simpleString()}>"

    def step(kept, c):
        fits = allowed(kept, c["x"]) if most is None else allowed(kept, c["x"]) & (F.size(kept) < most)
        return F.when(fits, F.array_append(kept, c["x"])).otherwise(kept)

    lists = df.groupBy(*by).agg(seen.alias("c"))
    return lists.select("key", F.explode(F.aggregate("c", F.array().cast(kind), step)).alias("x")).select("key", "x.*")


def spaced_top(df: DataFrame, spacing: int, most: int) -> DataFrame:
    """The best ``most`` of (key, id, t, score), no two closer than ``spacing``; ties by t, then id."""
    far = lambda kept, x: F.forall(kept, lambda y: F.abs(y["t"] - x["t"]) >= spacing)
    return chosen(df, [-F.col("score"), F.col("t"), F.col("id")], far, ["id", "t", "score"], most)


def suppressed(df: DataFrame, percent: int = 25) -> DataFrame:
    """Non-maximum suppression of (key, id, t0, t1, score): by score, dropping what shares more than ``percent`` of the
    shorter one with a kept one, or three tenths of both together."""

    def free(kept, x):
        both = lambda y: F.least(y["t1"], x["t1"]) - F.greatest(y["t0"], x["t0"])
        whole = lambda y: F.greatest(y["t1"], x["t1"]) - F.least(y["t0"], x["t0"])
        return F.forall(kept, lambda y: (100 * both(y) <= percent * F.least(y["t1"] - y["t0"], x["t1"] - x["t0"])) & (10 * both(y) < 3 * whole(y)))

    return chosen(isles(df, "t0", "t1", 1), [-F.col("score"), F.col("t0"), F.col("id")], free, ["id", "t0", "t1", "score"], by=("key", "_isle"))


def merge_close(df: DataFrame, gap: int) -> DataFrame:
    """Points (key, id, t) in order, kept when at least ``gap`` after the last kept one."""
    far = lambda kept, x: (F.size(kept) == 0) | (x["t"] - F.try_element_at(kept, F.lit(-1))["t"] >= gap)
    return chosen(isles(df, "t", "t", gap), [F.col("t"), F.col("id")], far, ["id", "t"], by=("key", "_isle"))


def budgeted(df: DataFrame, window: int, most: int) -> DataFrame:
    """Points (key, id, t) in order, kept while fewer than ``most`` kept ones lie within ``window`` before."""
    room = lambda kept, x: F.size(F.filter(kept, lambda y: x["t"] - y["t"] < window)) < most
    return chosen(isles(df, "t", "t", window), [F.col("t"), F.col("id")], room, ["id", "t"], by=("key", "_isle"))


def top_per_group(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("place") <= n)


def seeded_top(df: DataFrame, seeds: DataFrame, spans: DataFrame, least: int, most: int) -> DataFrame:
    """(key, id, t, score): up to ``most`` points of a key in all, its ``seeds`` (key, id, t) first and counted.

    The spacing is the larger of ``least`` and the key's span (key, t0, t1) over twice ``most``; a point closer than
    ``least`` to the end is never taken.
    """
    rows = df.select("key", "id", "t", "score").join(spans.select("key", "t0", "t1"), "key").where(F.col("t1") - F.col("t") >= least)
    space = F.greatest(F.lit(2 * most * least), F.col("t1") - F.col("t0"))
    marked = rows.select("key", "id", "t", "score", space.alias("s"), F.lit(1).alias("r")).unionByName(
        seeds.join(spans.select("key", "t0", "t1"), "key").select("key", "id", "t", F.lit(0).cast(df.schema["score"].dataType).alias("score"), space.alias("s"), F.lit(0).alias("r"))
    )
    far = lambda kept, x: (x["r"] == 0) | F.forall(kept, lambda y: 2 * most * F.abs(y["t"] - x["t"]) >= x["s"])
    out = chosen(marked, [F.col("r"), -F.col("score"), F.col("t"), F.col("id")], far, ["id", "t", "score", "s", "r"], most)
    return out.select("key", "id", "t", F.when(F.col("r") == 1, F.col("score")).alias("score"))


def covered_budget(df: DataFrame, budget: int, window: int, most: int) -> DataFrame:
    """(key, id, t0, t1, score), best first, while their lengths add up to ``budget`` at most and no ``window`` from a kept
    start holds more than ``most`` starts."""

    def fits(kept, x):
        used = F.aggregate(kept, F.lit(0).cast("long"), lambda a, y: a + y["t1"] - y["t0"])
        starts = F.array_append(F.transform(kept, lambda y: y["t0"]), x["t0"])
        crowded = F.exists(starts, lambda s: F.size(F.filter(starts, lambda y: (y >= s) & (y < s + window))) > most)
        return (used + x["t1"] - x["t0"] <= budget) & ~crowded

    return chosen(df, [-F.col("score"), F.col("t0"), F.col("id")], fits, ["id", "t0", "t1", "score"])


def rate_limited(df: DataFrame, gap: int, window: int, most: int) -> DataFrame:
    """(key, id, t, score), best first: no two closer than ``gap``, and at most ``most`` in any ``window`` from a kept one
    at or before the candidate (or the candidate itself).  One candidate for each time, the best by score, then id."""
    best = df.groupBy("key", "t").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m")).select("key", F.col("m.id").alias("id"), "t", (-F.col("m.s")).alias("score"))

    def fits(kept, x):
        times = F.array_append(F.filter(F.transform(kept, lambda y: y["t"]), lambda y: F.abs(y - x["t"]) < window), x["t"])
        crowded = F.exists(times, lambda s: (s <= x["t"]) & (F.size(F.filter(times, lambda y: (y >= s) & (y < s + window))) > most))
        return F.forall(kept, lambda y: F.abs(y["t"] - x["t"]) >= gap) & ~crowded

    return chosen(isles(best, "t", "t", max(gap, window)), [-F.col("score"), F.col("t"), F.col("id")], fits, ["id", "t", "score"], by=("key", "_isle"))


def slots(df: DataFrame, spacing: int, air: int, most: int, bucket: int, spare: int = 3) -> DataFrame:
    """(key, id, t0, t1, score, taken) of candidates with ``busy``: up to ``most`` of the best, ``spacing`` between starts
    and ``air`` between spans (``bucket``: see ``overlapping``); busy ones are never taken, but up to ``spare`` of them, spaced too and clear of the taken
    ones, are returned as not taken."""

    def fits(kept, x):
        done = F.filter(kept, lambda y: ~y["busy"])
        clash = F.exists(done, lambda y: (F.abs(y["t0"] - x["t0"]) < spacing) | ((x["t0"] < y["t1"] + air) & (y["t0"] < x["t1"] + air)))
        waiting = F.filter(kept, lambda y: y["busy"])
        room = (F.size(waiting) < spare) & ~F.exists(waiting, lambda y: F.abs(y["t0"] - x["t0"]) < spacing)
        return (F.size(done) < most) & ~clash & (~x["busy"] | room)

    out = chosen(df, [-F.col("score"), F.col("t0"), F.col("id")], fits, ["id", "t0", "t1", "score", "busy"])
    near = overlapping(out.where("busy").select("key", "id", (F.col("t0") - air).alias("t0"), (F.col("t1") + air).alias("t1")), out.where("not busy").select("key", "t0", "t1"), bucket)
    spoiled = near.select("key", "id").distinct()
    return out.join(spoiled, ["key", "id"], "left_anti").select("key", "id", "t0", "t1", "score", (~F.col("busy")).alias("taken"))


def first_wins(df: DataFrame, bucket: int) -> DataFrame:
    """(key, id, t0, t1, score, also): of overlapping (key, id, t0, t1, score, kind) the best stays, ties by start and id;
    ``also`` lists the kinds of those that lost to it, best first.  ``bucket``: see ``overlapping``."""
    order = [-F.col("score"), F.col("t0"), F.col("id")]
    free = lambda kept, x: F.forall(kept, lambda y: (x["t1"] <= y["t0"]) | (x["t0"] >= y["t1"]))
    kept = chosen(isles(df, "t0", "t1", 1), order, free, ["id", "t0", "t1", "score"], by=("key", "_isle"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    lost = df.join(kept.select("key", "id"), ["key", "id"], "left_anti")
    ranked = kept.withColumn("r", rank)
    to = overlapping(lost.select("key", "id", "t0", "t1", "score", "kind"), ranked, bucket).groupBy("key", "id", "kind", "score", "t0").agg(F.min(F.struct("b_r", "b_id")).alias("m"))
    also = to.groupBy("key", F.col("m.b_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "t0", F.col("id").alias("i"), "kind"))).alias("l"))
    texts = also.select("key", "id", F.array_join(F.transform("l", lambda x: x["kind"]), ",").alias("also"))
    return kept.join(texts, ["key", "id"], "left").select("key", "id", "t0", "t1", "score", F.coalesce("also", F.lit("")).alias("also"))


def first_list_wins(fixes: DataFrame) -> DataFrame:
    """Fixes (key, list, id, i, n) of spans [i, i + n): those of earlier lists win on overlap, in a list those that come first."""
    free = lambda kept, x: F.forall(kept, lambda y: (x["i"] + x["n"] <= y["i"]) | (x["i"] >= y["i"] + y["n"]))
    apart = isles(fixes.withColumn("_end", F.col("i") + F.col("n")), "i", "_end", 1)
    return chosen(apart, [F.col("list"), F.col("i"), F.col("id")], free, ["list", "id", "i", "n"], by=("key", "_isle"))
