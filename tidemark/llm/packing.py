"""Packing: length buckets that are optimal for the corpus, and token-budget batches inside each.

A dynamic program over the global histogram of lengths chooses bucket limits that minimise padding (every
document is padded to its bucket's limit).  Batches of a bucket hold as many documents as the token budget
allows at that limit, one at least.  A document longer than the budget has a batch of its own, is kept whole
and needs no padding: these form one more bucket, after the others, whose limit is each document's own length.

The histogram is exact.  It covers the lengths up to the budget, so it has ``budget`` + 1 rows at most, whatever
the corpus; that is all that reaches the driver.  Documents are numbered inside a bucket by md5 of their id, or
in the order they were written in, in slices of fixed size, so no bucket meets in one task.
Null and empty texts have 0 tokens and are packed like any other.  Repeated ids keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_files, numbered, numbered_in_order, with_position, words, written


def optimal_limits(lengths: np.ndarray, counts: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """Ascending limits of at most ``buckets`` buckets that minimise sum(limit * count) - sum(tokens).

    lengths ascend; tokens are each cell's summed true lengths.  Layer by layer, the best split point never
    moves left as the prefix grows (the cost obeys the quadrangle inequality), so each layer is solved by
    halving the range of split points.
    """
    m = len(lengths)
    if not m:
        return []
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    t = np.concatenate([[0], np.cumsum(tokens)]).astype(np.float64)
    size = lengths.astype(np.float64)

    def cost(i, j):  # one bucket over the cells i .. j - 1
        return size[j - 1] * (n[j] - n[i]) - (t[j] - t[i])

    best = np.concatenate([[0.0], [cost(0, j) for j in range(1, m + 1)]])
    splits = [np.zeros(m + 1, np.int64)]
    for _ in range(1, min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0.0
        stack = [(1, m, 0, m)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            k = int(np.argmin(total))
            new[mid], cut[mid] = total[k], i[k]
            stack += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        splits.append(cut)
        best = new
    limits, j = [], m
    for cut in reversed(splits):
        if j == 0:
            break
        limits.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(limits)


def token_counts(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, others: tuple[str, ...] = ()) -> DataFrame:
    """id, ``others`` and n_tokens of every whole text: words, or ids of the tokenizer file at the path ``tokenizer``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        if tokenizer:
            from tokenizers import Tokenizer

            encode = Tokenizer.from_file(tokenizer)
            encode.encode_special_tokens = True
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            if encode:
                n = [len(e.ids) for lo in range(0, len(texts), 64) for e in encode.encode_batch(texts[lo : lo + 64], add_special_tokens=False)]
            else:
                n = [len(words(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(n, pa.int64())], names=[id_col, *others, "n_tokens"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, *others))
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), *others).mapInArrow(run, f"{kinds}n_tokens long")


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8, budget: int = 65_536, tokenizer: str | None = None, in_order: bool = False,
) -> DataFrame:
    """One row per document: id, n_tokens, bucket (from 0, by length), bucket_limit, batch (from 0 in its bucket),
    place (from 0 in its batch), padding.

    Batches of a bucket are filled by md5 of the ids; with ``in_order`` in the order ``docs`` was written in.
    """
    return _placements(docs, id_col, text_col, buckets, budget, tokenizer, in_order).drop("_file", "_at")


def packed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8, budget: int = 65_536, tokenizer: str | None = None) -> DataFrame:
    """``docs`` as written, all columns and rows, with the columns of ``packed(in_order=True)`` after them.

    ``docs`` that is more than a scan of files is written first.  Rows find their places by where they stand in the written files, so repeated and null ids keep their own.
    Columns of ``docs`` that are named like the new ones give way to them.
    """
    docs = as_files(docs, "packing-rows")
    places = written(_placements(docs, id_col, text_col, buckets, budget, tokenizer, True).drop(id_col), "packing-places")
    rows = with_position(docs).drop(*(c for c in places.columns if c not in ("_file", "_at")))
    return rows.join(places.hint("merge"), ["_file", "_at"]).drop("_file", "_at")


def _placements(docs: DataFrame, id_col: str, text_col: str, buckets: int, budget: int, tokenizer: str | None, in_order: bool) -> DataFrame:
    """The rows of ``packed``; with ``in_order`` also _file and _at."""
    position = ("_file", "_at") if in_order else ()
    docs = as_files(docs, "packing-rows") if in_order else docs
    counts = written(token_counts(with_position(docs) if in_order else docs, id_col, text_col, tokenizer, position), "packing-counts")
    hist = counts.where(F.col("n_tokens") <= budget).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toPandas()
    lengths, n = hist["n_tokens"].to_numpy(), hist["n"].to_numpy()
    limits = optimal_limits(lengths, n, lengths * n, buckets)
    bucket = F.lit(0)
    for limit in limits:
        bucket = bucket + (F.col("n_tokens") > limit).cast("int")
    counts = counts.withColumn("bucket", bucket)
    placed = numbered_in_order(counts, "bucket", "_row") if in_order else numbered(counts, "bucket", id_col, "_row")
    table = F.array(*(F.lit(x).cast("long") for x in limits)) if limits else F.array().cast("array<long>")
    limit = F.coalesce(F.get(table, F.col("bucket")), F.col("n_tokens"))
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(limit, F.lit(1))), F.lit(1))
    return placed.select(
        F.col(id_col), *position, "n_tokens", "bucket", limit.alias("bucket_limit"), F.floor(F.col("_row") / room).cast("long").alias("batch"),
        (F.col("_row") % room).cast("long").alias("place"), (limit - F.col("n_tokens")).alias("padding"),
    )
