"""Timeline JSON files as clip and sequence tables, and the text sinks of review results.

A sequence has video and audio tracks, a track has clips; several names mean the same field, the first that is
set wins.  The sentinel -400000 and negative points are null; a speed of 0 is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed field names and kinds of the format.
CLIP = "struct<name:string,path:string,media:string,start:double,end:double,in:double,inPoint:double,out:double,outPoint:double,speed:double,disabled:boolean,selected:boolean,nodeId:string>"
TRACK = f"struct<index:int,idx:int,name:string,muted:boolean,locked:boolean,clips:array<{CLIP}>>"
SEQUENCE = f"id string, name string, fps double, width int, height int, duration double, inPoint string, outPoint string, video array<{TRACK}>, audio array<{TRACK}>, markers array<struct<t:double,name:string>>"
UNSET = -400_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of ``path``; fields that a file lacks are null, extra ones are ignored."""
    return spark.read.schema(SEQUENCE).option("multiLine", True).json(path)


def point(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number >= 0, number)


def clips(sequences: DataFrame) -> DataFrame:
    """(id, kind, track, clip, name, path, t0, t1, src_in, src_out, speed, disabled, muted), clips numbered by start."""
    tracks = None
    for kind in ("video", "audio"):
        one = sequences.select("id", F.lit(kind).alias("kind"), F.posexplode(kind).alias("_p", "_t"))
        tracks = one if tracks is None else tracks.unionByName(one)
    each = tracks.select("id", "kind", F.coalesce("_t.index", "_t.idx", "_p").alias("track"), F.coalesce("_t.muted", F.lit(False)).alias("muted"), F.explode("_t.clips").alias("c"))
    speed = F.when(F.coalesce(F.col("c.speed"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("c.speed"))
    out = each.select(
        "id", "kind", "track", "c.name", F.coalesce("c.path", "c.media").alias("path"), F.col("c.start").alias("t0"), F.col("c.end").alias("t1"),
        F.coalesce("c.in", "c.inPoint").alias("src_in"), F.coalesce("c.out", "c.outPoint").alias("src_out"), speed.alias("speed"), F.coalesce("c.disabled", F.lit(False)).alias("disabled"), "muted",
    )
    place = F.row_number().over(Window.partitionBy("id", "kind", "track").orderBy("t0", "t1", "name")) - 1
    return out.withColumn("clip", place)


def summaries(sequences: DataFrame) -> DataFrame:
    """(id, fps, in_point, out_point, duration): the stated duration, else the end of the last clip."""
    last = clips(sequences).groupBy("id").agg(F.max("t1").alias("_end"))
    rows = sequences.select("id", "fps", point(F.col("inPoint")).alias("in_point"), point(F.col("outPoint")).alias("out_point"), "duration")
    return rows.join(last, "id", "left").select("id", "fps", "in_point", "out_point", F.coalesce("duration", "_end", F.lit(0.0)).alias("duration"))


def audible(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("muted") & ~F.col("disabled") & F.col("path").isNotNull())


def of_media(media: DataFrame) -> DataFrame:
    """Sequences of one clip each, in the form of ``clips``, from media (path, duration)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    zero = F.lit(0.0)
    return media.select(
        F.sha1("path").alias("id"), F.lit("video").alias("kind"), F.lit(0).alias("track"), name.alias("name"), "path", zero.alias("t0"), F.col("duration").alias("t1"),
        zero.alias("src_in"), F.col("duration").alias("src_out"), F.lit(1.0).alias("speed"), F.lit(False).alias("disabled"), F.lit(False).alias("muted"), F.lit(0).alias("clip"),
    )


def json_texts(spark: SparkSession, path: str, schema: str, default: str = "{}") -> DataFrame:
    """(file, data): one row per JSON file, a byte order mark ignored; files that are no JSON give the default's data."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    good = F.when(F.expr("try_parse_json(value)").isNotNull(), F.col("value")).otherwise(F.lit(default))
    return raw.select("file", F.from_json(good, schema).alias("data"))


def cached_words(spark: SparkSession, path: str, media: DataFrame, version: int, model: str | None = None, lang: str | None = None) -> DataFrame:
    """(path, n, text, t0, t1, seg, prob) of the word caches (v, hash, model, lang, words) whose version and media's hash are
    current, and whose model and language are the asked ones; ``media`` is (path, hash).  Media without a cache give no rows."""
    schema = "v int, hash string, model string, lang string, words array<struct<text:string,start:double,end:double,seg_end:int,prob:double>>"
    docs = json_texts(spark, path, schema).select("data.*").where(F.col("v") == version)
    docs = docs if model is None else docs.where(F.col("model") == model)
    docs = docs if lang is None else docs.where(F.col("lang") == lang)
    rows = media.select("path", "hash").join(docs.dropDuplicates(["hash"]), "hash").select("path", F.posexplode("words").alias("n", "w"))
    return rows.select("path", "n", F.col("w.text").alias("text"), F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), (F.coalesce("w.seg_end", F.lit(0)) > 0).alias("seg"), F.coalesce("w.prob", F.lit(1.0)).alias("prob"))


def library(spark: SparkSession, folder: str, suffixes: tuple[str, ...], depth: int, exclude: tuple[str, ...] = (), most: int = 5000) -> DataFrame:
    """(file, size): media files under a folder by suffix, up to ``depth`` folders down, without those in excluded or hidden
    folders; the first ``most`` by name.  Only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
    root = "file:" + folder.rstrip("/") + "/" if folder.startswith("/") else folder.rstrip("/") + "/"
    inner = F.substr("path", F.length(F.lit(root)) + 1)
    parts = F.split(inner, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    kept = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes) & (F.size(folders) <= depth) & ~F.exists(folders, lambda x: x.startswith(".") | x.isin(*exclude))
    return files.where(kept).select(inner.alias("file"), "size").orderBy("file").limit(most)


def write_texts(lines: DataFrame, path: str, column: str, order: list[str]) -> None:
    """One text file per key under ``path``/key=..., its lines in order."""
    lines.repartition("key").sortWithinPartitions("key", *order).select("key", F.col(column).cast("string").alias("value")).write.partitionBy("key").text(path)
