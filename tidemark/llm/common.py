"""What several operators share: words, shared tables, distributed row numbers.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return.  On UTF-8 bytes that is exactly ``bytes.split()``, and no byte of a longer code point
can be one of those six, so words are split as bytes.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

_own_dir: list[str] = []
#: Paths of the tables written by this session.
_made: list[str] = []


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; null has none."""
    return text.encode().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where it is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "unknown").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _own_dir[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, keeps columns prunable and computes Python
    stages once however often the result is used.
    """
    return _stored(df, f"{shared_dir(df.sparkSession)}/tidemark/{label}-{uuid.uuid4().hex}")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Remove the written tables of this session that are still there, once all results that read them are stored.

    Results are lazy and read these tables, so nothing removes them before.  Returns how many there were.
    """
    n = sum(_remove(spark, path) for path in _made)
    _made.clear()
    return n


def _remove(spark: SparkSession, folder: str) -> bool:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables of one run in one folder of the shared folder, removed when the block ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return _stored(df, f"{self.folder}/{self.n:03d}-{name}")

    def __exit__(self, *_) -> None:
        _remove(self.spark, self.folder)


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def md5_sample(df: DataFrame, id_col: str, limit: int, total: int) -> DataFrame:
    """At most ``limit`` rows of ``df``: those whose id has the smallest md5.

    ``total`` is about the number of rows; a cut at its share of all md5 values comes first, so tasks hand over
    about 1.5 times ``limit`` rows together, whatever their number.  A null id has the smallest value.
    """
    key = F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("0" * 32))
    share = min(1.0, (1.5 * limit + 100) / max(total, 1))
    below = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") < int(share * 2**32)
    return df.where(below).withColumn("_k", key).orderBy("_k").limit(limit).drop("_k")


def with_position(df: DataFrame) -> DataFrame:
    """``df`` and where its rows stand: _file and _at, which ascend in the order the rows were written.

    ``df`` reads files and does nothing else (see ``as_files``): a row stands by file path and row index, however Spark
    cuts and deals the files; the part files of one write are named in order.
    """
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})


def as_files(df: DataFrame, label: str) -> DataFrame:
    """``df`` itself where it is a plain scan of files, so that every row has one place; else written first."""
    plain = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    try:
        if plain and df.select("_metadata.row_index").schema:
            return df
    except AnalysisException:
        pass  # a source without files
    return written(df, label)


def numbered_in_order(df: DataFrame, group: str, out: str, slice_rows: int = 10_000) -> DataFrame:
    """Number the rows of each group from 0 by _file and _at (see ``with_position``), in slices of neighbours.

    ``group``, _file and _at hold no nulls.  _file and _at stay.
    """
    df = df.withColumn("_slice", F.struct("_file", F.floor(F.col("_at") / slice_rows).alias("at")))
    return _placed(df, group, ["_at"], out)


def numbered(df: DataFrame, group: str, key: str, out: str, digits: int = 3) -> DataFrame:
    """Number the rows of each group from 0 by md5 of ``key`` without gathering a group in one task.

    A row's md5 orders it; its leading hex ``digits`` cut a group into slices (4,096 for three) whose sizes are
    counted first, so a row's number is its slice's offset plus its place in the slice.  The slices are the same
    at every size, and the numbers are the same for any ``digits``.  Null keys come first, equal keys take
    neighbouring numbers in no stated order.  ``group`` holds no nulls, so the join by equality finds the rows
    where the window has put them.
    """
    df = df.withColumn("_order", F.coalesce(F.md5(F.col(key).cast("string").cast("binary")), F.lit("")))
    df = df.withColumn("_slice", F.substring("_order", 1, digits))
    return _placed(df, group, ["_order", key], out).drop("_order")


def _placed(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Number each group's rows from 0 by _slice, then by ``order`` inside a slice."""
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(group, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), "_offset")
    )
    place = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*order)) - 1
    return (
        df.withColumn("_place", place)
        .join(offsets, (F.col(group) == F.col("_g")) & (F.col("_slice") == F.col("_s")), "left")
        .withColumn(out, (F.col("_offset") + F.col("_place")).cast("long"))
        .drop("_slice", "_place", "_offset", "_g", "_s")
    )


# ---- hashes of word sequences ------------------------------------------------------------------

#: Fixed odd multipliers of the window hashes, and of the final mixing.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers.get(base, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(up) < n:
        size = max(n, 2 * len(up), 4096)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            one = np.ones(1, np.uint64)
            up = np.cumprod(np.concatenate([one, np.full(size - 1, base, np.uint64)]))
            down = np.cumprod(np.concatenate([one, np.full(size - 1, inverse, np.uint64)]))
        _powers[base] = (up, down)
    return up, down


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def window_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """64-bit hash of every window of ``length`` consecutive words, by prefix sums of a polynomial."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(BASES[which], len(hashes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        return mixed((sums[length:] - sums[:-length]) * down[:n] + np.uint64(length))
