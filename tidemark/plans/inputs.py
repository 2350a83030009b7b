"""Timelines made from the driver tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import tokens

HOUR = 3_600_000_000
#: Start of the scope that some queries use, and its end: 5 and 20 January 2024.
LO, HI = 1_704_412_800_000_000, 1_705_708_800_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def hundredths() -> Column:
    return F.floor(F.col("value") * 100 + 0.5).cast("long")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """One interval per event: key = user, t0 = time, length = six seconds per hundredth of its value."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), micros().alias("t0"), hundredths().alias("v"))
    return e.withColumn("t1", F.col("t0") + F.col("v") * 6_000_000)


def side(spark: SparkSession, d: str, a: bool) -> DataFrame:
    kinds = F.col("kind").isin("click", "view")
    return spans(spark, d).where(kinds if a else ~kinds)


def points(spark: SparkSession, d: str) -> DataFrame:
    return side(spark, d, False).select("key", "id", F.col("t0").alias("t"))


def marks(spark: SparkSession, d: str) -> DataFrame:
    return side(spark, d, True).select("key", "id", F.col("t0").alias("t"))


def series(spark: SparkSession, d: str) -> DataFrame:
    """Frames of ten minutes: key = event type, v = summed hundredths of the values."""
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.floor(micros() / 600_000_000).cast("long").alias("i"), hundredths().alias("v"))
    return e.groupBy("key", "i").agg(F.sum("v").alias("v"))


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Words of conversations in milliseconds, with pauses and overlaps: key, n (place), text, t0, t1, seg (turn's end).

    A turn's words are counted before they are exploded, so only the turns are shuffled.
    """
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), "turn", F.filter(F.split("text", "[ \\n\\t]+"), lambda w: w != "").alias("w"))
    before = Window.partitionBy("key").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("off", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0)))
    rows = turns.select("key", "off", F.size("w").alias("size"), F.posexplode("w").alias("p", "text")).withColumn("n", (F.col("off") + F.col("p")).cast("long"))
    t0 = F.col("n") * 1000 + F.col("n") * 37 % 7 * 100
    return rows.select("key", "n", "text", t0.alias("t0"), (t0 + 200 + F.col("n") * 53 % 5 * 100).alias("t1"), (F.col("p") + 1 == F.col("size")).alias("seg"))


def sounding(spark: SparkSession, d: str) -> DataFrame:
    """Frames of 10 ms that sound: those of the words, but for a third, and some between them; a frame of two words comes twice."""
    frames = spoken(spark, d).select("key", "n", F.explode(F.sequence(F.floor(F.col("t0") / 10).cast("long"), F.floor(F.col("t1") / 10).cast("long") + 20)).alias("i"))
    return frames.where("(n * 7 + i div 9) % 3 != 0").select("key", "i")


def words(spark: SparkSession, d: str) -> DataFrame:
    return tokens.words(table(spark, d, "documents"), "doc_id", "text")


SPOKEN = """spoken as (select key, n, text, n * 1000 + n * 37 % 7 * 100 as t0, n * 1000 + n * 37 % 7 * 100 + 200 + n * 53 % 5 * 100 as t1, seg from (
  select conv_id as key, row_number() over (partition by conv_id order by turn, p) - 1 as n, text, p = size as seg from (
    select conv_id, turn, len(w) as size, x.text, x.p from (select conv_id, turn, list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda x: x <> '') as w from conversations), unnest(w) with ordinality as x(text, p))))"""
SOUNDING = "sounding as (select distinct key, i from (select key, n, unnest(range(t0 // 10, t1 // 10 + 21)) as i from spoken) where (n * 7 + i // 9) % 3 <> 0)"
SPANS = """spans as (select user_id as key, event_id as id, event_type as kind, epoch_us(ts) as t0, cast(floor(value * 100 + 0.5) as bigint) as v,
  epoch_us(ts) + cast(floor(value * 100 + 0.5) as bigint) * 6000000 as t1 from events),
sa as (select * from spans where kind in ('click', 'view')), sb as (select * from spans where kind not in ('click', 'view')),
points as (select key, id, t0 as t from sb), marks as (select key, id, t0 as t from sa)"""
SERIES = """series as (select event_type as key, epoch_us(ts) // 600000000 as i, cast(sum(cast(floor(value * 100 + 0.5) as bigint)) as bigint) as v from events group by all)"""
WORDS = """words as (select doc_id as key, cast(t.pos - 1 as int) as pos, t.token from documents,
  unnest(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '')) with ordinality as t(token, pos))"""


def merged(source: str, new: str = "e is null or t0 > e") -> str:
    """SQL of the islands of ``source`` (key, t0, t1)."""
    return f"""(select key, min(t0) as t0, max(t1) as t1 from (
  select key, t0, t1, sum(case when {new} then 1 else 0 end) over (partition by key order by t0, t1 rows unbounded preceding) as g from (
    select key, t0, t1, max(t1) over (partition by key order by t0, t1 rows between unbounded preceding and 1 preceding) as e from {source} where t0 < t1)) group by key, g)"""


def minus(a: str, b: str) -> str:
    """SQL of the parts of the merged table ``a`` that the merged table ``b`` leaves."""
    return f"""(select key, s as t0, coalesce((select least(min(y.t0), w1) from {b} y where y.key = x.key and y.t0 >= s), w1) as t1
  from (select a.key, a.t0 as s, a.t1 as w1 from {a} a union select a.key, b.t1, a.t1 from {a} a join {b} b on a.key = b.key and b.t1 >= a.t0 and b.t1 < a.t1) x
  where not exists (select 1 from {b} z where z.key = x.key and z.t0 <= s and s < z.t1))"""
