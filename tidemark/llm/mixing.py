"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents, in the order of their ids' md5, are cut into blocks.  With weight w of a total of W, a
source releases its k-th block (from 0) at slot floor(k * W / w) and must have run it by ceil((k + 1) * W / w).
Earliest deadline first (ties: the source's name) fills one slot after the other with a released block.  As
the weights' shares add up to one this meets all deadlines, so before any slot each source that still has
blocks is less than one block away from its exact share.

A fold schedules all blocks, a period of them at a time; what has not run by the end of a period goes on in the
next, with quotients and remainders of W / w carried over as whole numbers, so nothing is rounded and ``period``
does not change the result.  The fold runs in one task, whose time grows with blocks x sources.  Nothing is
dropped: when a source runs out the others go on, earlier if they are released, and slots without a released
block stay empty.  A null source is a source of its own.  Repeated ids keep a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import numbered, written


def shares(sources: DataFrame, period: int) -> DataFrame:
    """(source_key, weight: positive long) to (source_key, b): whole slots, one at least, that add up to ``period``.

    For a fixed period of at least as many slots as sources; ``mixed_order`` schedules by the exact weights instead.
    What one slot each leaves over is shared by weight; remainders go to the largest, then by name.
    """
    everything = Window.partitionBy()
    total, n = F.sum("weight").over(everything), F.count(F.lit(1)).over(everything)
    left = F.lit(period).cast("long") - n
    base = sources.select("source_key", (F.col("weight") * left).alias("_w"), total.alias("_t"), left.alias("_left"))
    whole = F.expr("_w div _t")
    base = base.select("source_key", whole.alias("_q"), (F.col("_w") % F.col("_t")).alias("_r"), "_left")
    rank = F.row_number().over(everything.orderBy(F.desc("_r"), "source_key"))
    spare = F.col("_left") - F.sum("_q").over(everything)
    return base.select("source_key", (F.col("_q") + 1 + (rank <= spare).cast("int")).cast("long").alias("b"))


def block_schedule(sources: DataFrame, period: int) -> DataFrame:
    """(source_key, weight: positive long, blocks: long) to (source_key, block, slot): the slot of every block."""
    everything = Window.partitionBy()
    numbers = sources.withColumns({
        "i": F.row_number().over(everything.orderBy("source_key")) - 1, "_t": F.sum("weight").over(everything), "_n": F.sum("blocks").over(everything),
    })
    # release now and of the next block, whose remainder is rem; the deadline now is that release, one later if something remains
    parts = numbers.withColumns({"q": F.expr("_t div weight"), "m": F.expr("_t % weight")}).where("blocks > 0")
    one = F.struct("i", "q", "m", F.col("weight").alias("w"), F.col("blocks").alias("n"), *(F.lit(0).cast("long").alias(c) for c in ("k", "now")), F.col("q").alias("next"), F.col("m").alias("rem"))
    state = F.array_sort(F.collect_list(one))
    never = F.lit(2**62).cast("long")

    def due(x):
        return x["next"] + (x["rem"] > 0).cast("long")

    def moved(x):
        rem = x["rem"] + x["m"]
        over = (rem >= x["w"]).cast("long")
        done = x["k"] + 1
        return F.struct(
            x["i"].alias("i"), x["q"].alias("q"), x["m"].alias("m"), x["w"].alias("w"), x["n"].alias("n"), done.alias("k"),
            F.when(done < x["n"], x["next"]).otherwise(never).alias("now"), (x["next"] + x["q"] + over).alias("next"), (rem - over * x["w"]).alias("rem"),
        )

    def step(acc, _):
        # the first slot in which a block is released; in it the earliest deadline; then the source's name
        best = F.array_min(F.transform(acc["s"], lambda x: F.struct(F.greatest(x["now"], acc["slot"]).alias("slot"), due(x).alias("due"), x["i"].alias("i"), x["k"].alias("block"))))
        pick = F.array(best)  # an array of one, so that the choice is evaluated once
        after = F.transform(
            pick,
            lambda p: F.struct(
                F.transform(acc["s"], lambda x: F.when(x["i"] == p["i"], moved(x)).otherwise(x)).alias("s"), (p["slot"] + 1).alias("slot"),
                F.array_append(acc["picks"], F.struct(p["i"].alias("i"), p["block"].alias("block"), p["slot"].alias("slot"))).alias("picks"),
            ),
        )
        return F.element_at(after, 1)

    def one_period(acc, p):
        steps = F.sequence(F.lit(1).cast("long"), F.least(F.lit(period).cast("long"), F.col("total") - p * period))
        inner = F.array(F.aggregate(steps, F.struct(acc["s"].alias("s"), acc["slot"].alias("slot"), none.alias("picks")), step))
        after = F.transform(inner, lambda r: F.struct(r["s"].alias("s"), r["slot"].alias("slot"), F.array_append(acc["periods"], r["picks"]).alias("periods")))
        return F.element_at(after, 1)

    none = F.array().cast("array<struct<i:int,block:bigint,slot:bigint>>")
    start = F.struct(F.col("state").alias("s"), F.lit(0).cast("long").alias("slot"), F.array().cast("array<array<struct<i:int,block:bigint,slot:bigint>>>").alias("periods"))
    gathered = parts.agg(state.alias("state"), F.max("_n").alias("total")).where("total > 0")
    periods = F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {int(period)}"))
    picks = gathered.select(F.explode(F.flatten(F.aggregate(periods, start, one_period)["periods"])).alias("p"))
    return picks.select("p.*").join(numbers.select("i", "source_key"), "i").select("source_key", "block", "slot")


def period_schedule(share: DataFrame, period: int) -> DataFrame:
    """(source_key, nth, slot, b): the slot in the period of each source's nth block; b adds up to ``period``."""
    slots = block_schedule(share.select("source_key", F.col("b").alias("weight"), F.col("b").alias("blocks")), period)
    return slots.withColumnRenamed("block", "nth").join(share, "source_key").select("source_key", "nth", "slot", "b")


def mixed_order(
    docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", period: int = 1000, block: int = 20
) -> DataFrame:
    """One row per document: id, source, block number, slot, mix_rank (unique, ascending in the mixed order)."""
    rows = _ranked(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source")), weights, period, block)
    return rows.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "block", "slot", "mix_rank")


def mixed_rows(
    docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", period: int = 1000, block: int = 20
) -> DataFrame:
    """The rows of ``docs`` with all their columns, sorted by the mixed order."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.struct(*docs.columns).alias("_doc"))
    return _ranked(rows, weights, period, block).orderBy("mix_rank").select("_doc.*")


def _ranked(docs: DataFrame, weights: DataFrame | None, period: int, block: int) -> DataFrame:
    """``docs`` (_id, _source and others) and block, slot and mix_rank.

    ``weights`` is (source, weight: long); sources it leaves out weigh 1, sources without documents do not count.  By default a source weighs the
    square root of its number of documents, in thousandths.
    """
    key = F.coalesce(F.concat(F.lit("s:"), F.col("_source").cast("string")), F.lit("null"))
    base = docs.withColumn("source_key", key)
    found = base.groupBy("source_key").agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weighted = found.withColumn("weight", F.greatest(F.round(F.sqrt("_n") * 1000).cast("long"), F.lit(1)))
    else:
        given = weights.select(F.concat(F.lit("s:"), F.col(weights.columns[0]).cast("string")).alias("source_key"), F.col(weights.columns[1]).cast("long").alias("_w"))
        weighted = found.join(given, "source_key", "left").withColumn("weight", F.greatest(F.coalesce("_w", F.lit(1)), F.lit(1)).cast("long"))
    sources = weighted.select("source_key", F.col("weight"), F.expr(f"(_n + {int(block)} - 1) div {int(block)}").alias("blocks"))
    schedule = written(block_schedule(written(sources, "mixing-sources"), period), "mixing-schedule")
    rows = numbered(base, "source_key", "_id", "_row").withColumn("block", F.floor(F.col("_row") / block).cast("long"))
    rows = rows.join(schedule, ["source_key", "block"], "left")
    return rows.withColumn("mix_rank", F.col("slot") * block + F.col("_row") % block)
