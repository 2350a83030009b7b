"""Sharding by sampled splitters, in DataFrame functions only.  The law is ``bytes``: shards of nearly equal sizes.

Records are ordered by a key of md5(text), md5(id) and their place, so copies of a text are neighbours and no two records
have one key.  A size-weighted sample of keys gives quantile boundaries; records are partitioned by these ranges, and a
range that turns out overfull is sampled again and subdivided until none is.  A group of copies of any size is cut by
the later parts of the key like everything else.  Sizes are summed by range, then inside each range, which
gives every record the exact number of bytes before it; the shard is the share of all bytes in which its middle lies.

So a shard holds its share of all bytes up to half a record at either end, whatever the sample, and the result depends on
nothing but the rows.  Copies of a text share a shard unless a shard's end falls among them.  Null texts have no bytes
(size 1); null ids count as an empty string; records equal in text and id are told apart by their place as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import written

LAW = "bytes"
#: Bytes of a key: eight each of md5(text), md5(id) and the place.
KEY = 24
#: Expected sampled keys per range.
SAMPLE = 32


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, text_crc32, _key): read once from the texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    digest = lambda c: F.substring(F.md5(c.cast("binary")), 1, 16)
    return docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.concat(digest(text), digest(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), place)).alias("_key"),
    )


def range_number(key: Column, bounds: list[bytes]) -> Column:
    """How many of the ascending ``bounds`` are at or below ``key``: a binary search in one literal."""
    table, n = F.lit(b"".join(bounds)), len(bounds)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    if not steps:
        return F.lit(0)
    at = lambda i: F.substring(table, (i - 1) * KEY + 1, F.lit(KEY))
    fits = lambda acc, s: (acc + s <= n) & (at(acc + s) <= key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda acc, s: acc + F.when(fits(acc, s), s).otherwise(0))


def _quantiles(rows: DataFrame, parts: Column, wanted: Column) -> list[bytes]:
    """Boundaries that cut each _range of ``rows`` (_range, _key, load, _total) into ``parts`` ranges of about equal load.

    A row is drawn with probability load * wanted / _total (at most 1) by a hash of its key, and stands for load /
    probability; so about ``wanted`` keys are drawn in a range and twice as many at most are expected.
    """
    chance = F.least(F.lit(1.0), F.col("load") * wanted / F.col("_total"))
    unit = F.pmod(F.xxhash64("_key"), F.lit(1 << 52)) / float(1 << 52)
    sample = rows.withColumn("_p", chance).where(unit < F.col("_p")).select("_range", "_key", (F.col("load") / F.col("_p")).alias("_w"), parts.alias("_parts"))
    line = Window.partitionBy("_range").orderBy("_key")
    share = F.sum("_w").over(line) / F.sum("_w").over(Window.partitionBy("_range"))
    part = F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1)
    cut = sample.withColumn("_part", part.cast("int")).groupBy("_range", "_part").agg(F.min("_key").alias("b")).where("_part > 0")
    return sorted(bytes(r.b) for r in cut.select("b").collect())


def splitters(keyed: DataFrame, ranges: int, total: int, rows: int, most_rounds: int = 20) -> list[bytes]:
    """At least ``ranges`` - 1 boundaries such that no range has more than three times its share of the load.

    A row's load is its size and the mean size, so ranges are bounded in bytes and in rows.  At most about ``SAMPLE`` x 2
    keys a range are drawn; the boundaries, ``KEY`` bytes each, are what the driver holds.
    """
    load = F.col("size") + F.lit(total // max(rows, 1))
    base = keyed.select("_key", load.cast("long").alias("load"))
    whole = total + total // max(rows, 1) * rows
    first = base.withColumns({"_range": F.lit(0), "_total": F.lit(float(max(whole, 1)))})
    bounds = _quantiles(first, F.lit(ranges), F.lit(SAMPLE * ranges))
    limit = 3 * whole / ranges
    for _ in range(most_rounds):
        placed = base.withColumn("_range", range_number(F.col("_key"), bounds))
        full = placed.groupBy("_range").agg(F.sum("load").cast("double").alias("_total"), F.count(F.lit(1)).alias("_n")).where((F.col("_total") > limit) & (F.col("_n") > 1))
        if full.isEmpty():
            break
        wide = placed.join(F.broadcast(full.select("_range", "_total")), "_range")  # a third of the ranges at most
        parts = F.ceil(F.col("_total") * 3 / F.lit(limit)).cast("int") + 1
        more = _quantiles(wide, parts, (parts * SAMPLE).cast("double"))
        if not set(more) - set(bounds):
            break  # what is left are single records larger than a range
        bounds = sorted(set(bounds) | set(more))
    return bounds


def _placed(keyed: DataFrame, shards: int, rows_a_range: int) -> DataFrame:
    """``keyed`` and shard and slot."""
    sums = keyed.agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n = sums.t or 0, sums.n
    ranges = max(4 * shards, -(-n // rows_a_range))
    bounds = splitters(keyed, ranges, total, n) if n else []
    ranged = keyed.withColumn("_range", range_number(F.col("_key"), bounds))
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = (
        ranged.groupBy("_range").agg(F.sum("size").alias("_b"), F.count(F.lit(1)).alias("_c"))
        .select("_range", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_rows"))
    )
    line = Window.partitionBy("_range").orderBy("_key")
    inside = ranged.withColumns({"_to": F.sum("size").over(line), "_nth": F.row_number().over(line) - 1})
    middle = inside.join(F.broadcast(offsets), "_range").withColumn("_middle", 2 * (F.col("_bytes") + F.col("_to")) - F.col("size"))
    shard = F.expr(f"(_middle * {shards}L) div {2 * max(total, 1)}L").cast("int")  # exact up to 2**62 bytes x shards
    return middle.select("_id", "size", "text_crc32", shard.alias("shard"), (F.col("_rows") + F.col("_nth")).alias("_row"))


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rows_a_range: int = 500_000) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null).

    ``rows_a_range`` bounds the rows that one task sorts; there are four ranges a shard at least.
    """
    return _slotted(written(_keyed(docs, id_col, text_col), "op11-keys"), shards, rows_a_range).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _slotted(keyed: DataFrame, shards: int, rows_a_range: int) -> DataFrame:
    placed = written(_placed(keyed, shards, rows_a_range), "op11-placed")
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", (F.col("_row") - F.col("_first")).cast("long")).drop("_row", "_first")
