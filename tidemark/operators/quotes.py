"""Which unit of a transcript a quote and a claimed time point at."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import norm
from tidemark.operators.intervals import overlapping


def quote_score(quote: str, text: str, at_start: bool = True) -> Column:
    """How well normalised quotes match the start (or end) of normalised texts: 1 there, 0.9 elsewhere, else the ratio to
    the text's first (last) letters, four more than the quote has; 0 without a quote."""

    def one(q: str, t: str) -> float:
        if not q:
            return 0.0
        if q in t:
            return 1.0 if (t.startswith(q) if at_start else t.endswith(q)) else 0.9
        size = len(q) + 4
        return SequenceMatcher(None, q, t[:size] if at_start else t[-size:]).ratio()

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return run(quote, text)


def resolved(asks: DataFrame, units: DataFrame, at_start: bool = True, near: int = 4000, accept: float = 0.72, far: int = 15_000) -> DataFrame:
    """(key, id, n, how) for asks (key, id, t, quote, after) over units (key, n, t0, t1, text); n above ``after`` (null: any).

    ``ok``: of the units within ``near`` of t the one that fits the quote best (the later of equals), if it fits by
    ``accept``; without a quote the nearest one, the earlier of equals.  Else ``quote``: of all units the best fit, less up to 0.1 by its
    distance from t over ten minutes, the earliest of equals.  Else ``time``: the nearest unit within ``far``, the earliest of equals.
    Else ``none`` and null.  Times are ms; t and quote may be null.

    The first stage is a bucketed interval join; only asks it leaves open meet the other units of their key.
    """
    time = F.col("t0" if at_start else "t1")
    base = asks.select("key", "id", F.col("t").alias("at"), F.coalesce(norm(F.col("quote")), F.lit("")).alias("q"), F.coalesce("after", F.lit(-1)).alias("after")).where("key is not null")
    table = units.select("key", "n", time.alias("u"), norm(F.col("text")).alias("text"))

    window = base.where("at is not null").withColumns({"t0": F.col("at") - near, "t1": F.col("at") + near + 1})
    hits = overlapping(window, table.withColumns({"t0": F.col("u"), "t1": F.col("u") + 1}), 60_000, "ab").where("b_n > after")
    hits = hits.withColumn("score", F.when(F.col("q") != "", quote_score("q", "b_text", at_start)))
    away = F.abs(F.col("b_u") - F.col("at"))
    best = hits.groupBy("key", "id").agg(F.max(F.struct("score", F.col("b_n").alias("n"))).alias("said"), F.min(F.struct(away.alias("d"), F.col("b_n").alias("n"))).alias("close"))
    first = F.when(F.col("said.score") >= accept, F.col("said.n")).when(F.col("said.score").isNull(), F.col("close.n"))
    staged = base.join(best.select("key", "id", first.alias("n1")), ["key", "id"], "left")

    rest = staged.where("n1 is null").drop("n1").join(table, "key").where("n > after")
    distance = F.abs(F.col("u") - F.col("at"))
    fit = F.when(F.col("q") != "", quote_score("q", "text", at_start) - F.when(F.col("at").isNull(), 0.0).otherwise(F.least(distance, F.lit(600_000)) / 6_000_000))
    rest = rest.withColumns({"fit": fit, "d": distance}).groupBy("key", "id").agg(F.min(F.struct((-F.col("fit")).alias("f"), "n")).alias("said"), F.min(F.when(F.col("d").isNotNull(), F.struct("d", "n"))).alias("close"))
    # a null fit sorts first and is no hit
    second, third = F.when(-F.col("said.f") >= accept, F.col("said.n")), F.when(F.col("close.d") <= far, F.col("close.n"))
    out = staged.join(rest.select("key", "id", second.alias("n2"), third.alias("n3")), ["key", "id"], "left")
    how = F.when(F.col("n1").isNotNull(), "ok").when(F.col("n2").isNotNull(), "quote").when(F.col("n3").isNotNull(), "time").otherwise("none")
    return out.select("key", "id", F.coalesce("n1", "n2", "n3").alias("n"), how.alias("how"))
