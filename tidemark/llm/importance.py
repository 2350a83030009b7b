"""Target-distribution importance resampling: array-scored weights, then a distributed radix selection.

Features are hashed n-grams.  Their counts over all documents and over the target texts give each of the BUCKETS
buckets a whole-number gain; a document's weight is the sum of its features' gains, looked up in one array.  A hash of
the id adds Gumbel noise, so the k highest scores are a draw without replacement.

The k-th key is found exactly: keys are (score falling, id rising, place as written), unique, and each round counts the
rows that agree with the digits found so far by their next 16 bits.  Only 65,536 counts at most reach the driver.
Rows at or before the k-th key, exactly k, are range-sorted and ranked by what their ranges before them hold.

Null texts have no words.  A null id is hashed as an empty string and comes after all ids of its score.  Documents with fewer than
``least_words`` words are scored and never drawn.  Repeated ids keep a row each and are drawn one by one.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import written

BUCKETS = 10_000
#: Words in a feature at most.
NGRAM = 3
#: Bits of a radix digit.
DIGIT = 16

_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: A-Z folded, every byte that is in no word a space.
_FOLD = bytes((b + 32 if b in _UPPER else b if b in _LETTERS else 32) for b in range(256))

#: Words up to this many bytes are joined by tables; longer ones are hashed with their features written out.
TABLED = 64


def _shift_tables() -> np.ndarray:
    """[n][byte of the crc][value]: what n more zero bytes make of a crc without its initial value, which is linear."""
    one = np.empty((4, 256), np.uint32)
    step = np.array([zlib.crc32(bytes([v]), 0xFFFFFFFF) ^ 0xFFFFFFFF for v in range(256)], np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for k in range(4):
        crc = values << np.uint32(8 * k)
        one[k] = step[crc & 255] ^ (crc >> np.uint32(8))
    tables = np.empty((TABLED + 2, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = values << np.uint32(8 * k)
    for n in range(1, TABLED + 2):
        tables[n] = _shifted(tables[n - 1].ravel(), np.ones(1024, np.int64), one[None]).reshape(4, 256)
    return tables


def _shifted(crc: np.ndarray, by: np.ndarray, tables: np.ndarray) -> np.ndarray:
    by = by if len(tables) > 1 else np.zeros_like(by)
    m = np.uint32(255)
    return tables[by, 0, crc & m] ^ tables[by, 1, (crc >> np.uint32(8)) & m] ^ tables[by, 2, (crc >> np.uint32(16)) & m] ^ tables[by, 3, crc >> np.uint32(24)]


_TABLES = _shift_tables()
_SPACE = np.array([zlib.crc32(b" ")], np.uint32)
#: The crc of a space, carried over n bytes.
_SPACES = _shifted(np.repeat(_SPACE, TABLED + 1), np.arange(TABLED + 1), _TABLES)


def words(text: str | None) -> list[bytes]:
    """Words of digits, letters a-z (A-Z folded) and code points from U+0080 on, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def features(tokens: list[bytes]) -> np.ndarray:
    """Buckets of all runs of 1 to NGRAM words joined by one space: crc32 modulo BUCKETS.

    The crc of a joined run is that of its first words, carried over the length of the last, with the last one's added.
    """
    n = len(tokens)
    length = np.fromiter(map(len, tokens), np.int64, n)
    runs = [np.fromiter(map(zlib.crc32, tokens), np.uint32, n)]
    long = length > TABLED
    some = bool(long.any())
    short = np.minimum(length, TABLED)
    tail = _SPACES[short] ^ runs[0]  # a space and the word
    for k in range(1, NGRAM):
        if n <= k:
            break
        run = _shifted(runs[-1][:-1], short[k:] + 1, _TABLES) ^ tail[k:]
        if some:
            for i in np.flatnonzero(long[k:]):  # the run's last word is long
                run[i] = zlib.crc32(b" " + tokens[i + k], int(runs[-1][i]))
        runs.append(run)
    return np.concatenate(runs) % np.uint32(BUCKETS)


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket.  Tasks hand over one count a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                total += np.bincount(features(words(t.as_py())), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target's share over the smoothed source's share) by bucket."""
    total_s, total_t = float(source.sum()), float(target.sum())
    ratio = [((t + 1.0) * (total_s + BUCKETS)) / ((s + 1.0) * (total_t + BUCKETS)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise in thousandths from the first 32 bits of sha256(``seed:doc_id``)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


NEW = ("n_words", "n_features", "weight", "score")


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42, others: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``others``, n_words, n_features, weight, score) of every document."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i, t in zip(b.column(0), b.column(1)):
                tokens = words(t.as_py())
                found = features(tokens)
                weight = int(gain[found].sum())
                made.append((len(tokens), len(found), weight, weight + noise(i.as_py(), seed)))
            columns = list(zip(*made)) or [()] * len(NEW)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, *others, *NEW])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, *others))
    rows = docs.select(F.col(id_col).cast("string").alias("_i"), F.col(text_col).cast("string").alias("_t"), F.col(id_col), *others)
    return rows.mapInArrow(run, kinds + ", ".join(f"{c} long" for c in NEW))


#: The parts of the key, most significant first, as non-negative numbers that rise in the order of the draw.
PARTS = ("_falling", "_late", "_rising", "_at")


def kth_key(rows: DataFrame, k: int) -> list[int] | None:
    """The k-th smallest key (PARTS, non-negative longs, unique), from 1, of at least k ``rows``; None for k = 0.

    Each round counts the candidates by their next digit and keeps those of the digit in which the k-th lies.  A part's
    first digit holds the highest bit that any candidate has, so constant parts take no round.
    """
    if k <= 0:
        return None
    rows = rows.select(*PARTS)
    for part in PARTS:
        top = rows.agg(F.max(part)).first()[0].bit_length()
        for shift in reversed(range(0, top, DIGIT)):
            digit = F.shiftrightunsigned(part, shift).bitwiseAND((1 << DIGIT) - 1)
            for d, n in sorted(map(tuple, rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())):
                if k <= n:
                    break
                k -= n
            rows = rows.where(digit == d)
            if n == 1:
                return list(rows.first())
    return list(rows.first())


def drawn(scores: DataFrame, id_col: str = "doc_id", percent: int = 5, least_words: int = 20, rows_a_range: int = 1_000_000) -> DataFrame:
    """``scores`` (see ``scored``) with rank: 1, 2, 3 ... for the drawn rows in order, null for the others.

    Of N documents with ``least_words`` words, floor(percent * N / 100) are drawn.  Ids are whole numbers.
    """
    own, can = scores.columns, F.col("n_words") >= least_words
    table = written(scores.withColumn("_at", F.monotonically_increasing_id()), "op12-scores")
    first = table.agg(F.max("score").alias("score"), F.min(F.col(id_col).cast("long")).alias("id"), F.count(F.when(can, 1)).alias("n")).first()
    k = percent * first.n // 100
    rising = F.coalesce(F.col(id_col).cast("long") - F.lit(first.id or 0), F.lit(0))
    keyed = table.withColumns({"_falling": F.lit(first.score or 0) - F.col("score"), "_late": F.col(id_col).isNull().cast("long"), "_rising": rising})
    key = kth_key(keyed.where(can), k)
    if key is None:
        return table.select(*own, F.lit(None).cast("long").alias("rank"))
    upto = F.struct(*PARTS) <= F.struct(*(F.lit(v).cast("long").alias(p) for p, v in zip(PARTS, key)))
    # range-sort: the ranges ascend with their partition's number, which is written along
    ranges = max(8, -(-k // rows_a_range))
    ranged = written(keyed.where(can & upto).repartitionByRange(ranges, *PARTS).withColumn("_p", F.spark_partition_id()), "op12-chosen")
    before = Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*PARTS))
    ranked = ranged.withColumn("_nth", nth).join(F.broadcast(offsets), "_p").select(*own, (F.col("_o") + F.col("_nth")).cast("long").alias("rank"))
    return ranked.unionByName(keyed.where(~(can & upto)).select(*own, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null when not drawn)."""
    return drawn(scored(docs, target, id_col, text_col, seed=seed), id_col, percent, least_words).drop("n_words")


def resampled_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """The drawn rows of ``docs`` with their columns, then n_words, n_features, weight, score and rank, sorted by rank.

    Columns of ``docs`` named like the new ones give way to them.
    """
    others = tuple(c for c in docs.columns if c not in (id_col, *NEW, "rank"))
    return drawn(scored(docs, target, id_col, text_col, seed=seed, others=others), id_col, percent, least_words).where(F.col("rank").isNotNull()).orderBy("rank")
