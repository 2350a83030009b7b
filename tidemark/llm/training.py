"""Labelled rows for the models of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, md5_sample, written
from tidemark.llm.text_stats import COUNTS, FEATURES, feature_columns, with_counts

#: Most labelled documents a model is fitted on: the ones whose id has the smallest md5.
MAX_LABELLED = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", limit=MAX_LABELLED):
    """(x, y): the features of at most ``limit`` labelled documents outside the held-out fold.

    The ids are chosen before any text is read; of the texts that share an id, the one with the smallest counts.
    A document with several labels counts as 1 when they average one half or more; null labels and ids are left
    out.  Only this bounded table of numbers reaches the driver; the chosen ids, ``limit`` at most, are broadcast.
    """
    y = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    )
    known = written(y.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi"), "labels")
    chosen = written(md5_sample(known, "_id", limit, known.count()), "labels-chosen")
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen.select("_id")), "_id", "left_semi")
    one = with_counts(some, "_id").groupBy("_id").agg(F.min(F.struct(*COUNTS)).alias("c")).select("_id", "c.*")
    rows = one.join(F.broadcast(chosen), "_id").select("_id", "_y", *(c.alias(k) for k, c in feature_columns().items())).toPandas().sort_values("_id")
    return rows[list(FEATURES)].to_numpy(np.float64), rows["_y"].to_numpy(np.float64)
