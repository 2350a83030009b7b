"""Queries that walk a key's rows in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sequences as sq
from tidemark.operators import silence
from tidemark.plans.inputs import SERIES, SPANS, merged, minus, series, spans, table, words


def timed(s, d):
    """Conversation words with times: 400 ms a word and a pause of two seconds after each turn."""
    turn = table(s, d, "conversations").select(F.col("conv_id").alias("key"), "turn", F.posexplode(F.split("text", r"\s+")).alias("p", "token"))
    pos = (F.col("turn") * 1000 + F.col("p")).cast("int")
    return turn.select("key", pos.alias("pos"), (pos.cast("long") * 400).alias("t0"), (pos.cast("long") * 400 + 300).alias("t1"), F.col("token").rlike("[.!?]$").alias("stop"))


def levels(s, d):
    return series(s, d).withColumn("label", F.when(F.col("v") >= 2000, "high").when(F.col("v") >= 500, "mid").otherwise("low"))


def scored(s, d):
    v = F.col("v").cast("double") / 1000
    return series(s, d).select("key", "i", v.alias("high"), (2 - v).alias("low"))


def chapter_rows(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("title"))


def scope(s, d):
    return series(s, d).groupBy("key").agg(F.min("i").alias("t0"), F.max("i").alias("t1"))


VOICE = f"""loud as (select key, min(i) as t0, max(i) + 1 as t1 from (select *, sum(n) over (partition by key order by i) as g from (
  select *, case when coalesce(i - lag(i) over (partition by key order by i) > 1, true) then 1 else 0 end as n from series where v >= 500)) group by key, g having max(v) >= 2000),
bridged as {merged('loud', 'e is null or (t0 > e and t0 - e >= 4)')}, padded as (select key, t0 - 1 as t0, t1 + 2 as t1 from bridged where t1 - t0 >= 2), voice as {merged('padded')},
scope as (select key, min(i) as t0, max(i) as t1 from series group by key)"""
HOLES = f"""v as (select key, i as t0, i + 1 as t1 from series where v >= 1000), iv as {merged('v')},
w as (select key, i as t0, i + 1 as t1 from series where v % 3 = 0), iw as {merged('w')}, rest as {minus('iv', 'iw')}"""

ALL = {
    "fix_overlaps": (lambda s, d: sq.without_overlaps(spans(s, d).where("t0 < t1"), 1_000_000), f"""with recursive {SPANS}, r as (
      select *, row_number() over (partition by key order by t0, t1, id) as n from spans where t0 < t1), w as (
      select key, n, id, t0, greatest(t1, t0 + 1000000) as t1 from r where n = 1 union all
      select r.key, r.n, r.id, greatest(r.t0, w.t1), greatest(r.t1, greatest(r.t0, w.t1) + 1000000) from w join r on r.key = w.key and r.n = w.n + 1)
      select key, id, t0, t1 from w"""),
    "base_shots": (lambda s, d: sq.shots(levels(s, d), 2, 6), None),
    "viterbi": (lambda s, d: sq.viterbi(scored(s, d), ["high", "low"], 1.5), None),
    "rdp": (lambda s, d: sq.simplified(series(s, d).withColumn("v", F.col("v").cast("double")), 800.0), None),
    "chapters_merge_to_count": (lambda s, d: sq.merged_to_count(chapter_rows(s, d), 8, 86_400), None),
    "paginate": (lambda s, d: sq.pages(words(s, d), 32, 2), None),
    "silence_plan": (
        lambda s, d: silence.plan(series(s, d), scope(s, d), 500, 2000, 4, 2, 1, 2, 2),
        f"with {SERIES}, {VOICE} select * from {minus('scope', 'voice')} where t1 - t0 >= 2",
    ),
    "find_holes": (
        lambda s, d: silence.holes(series(s, d), series(s, d).where("v % 3 = 0").select("key", F.col("i").alias("t0"), (F.col("i") + 1).alias("t1")), 1000, 3, 2),
        f"with {SERIES}, {HOLES} select * from {merged('rest', 'e is null or (t0 > e and t0 - e >= 3)')} where t1 - t0 >= 2",
    ),
}
