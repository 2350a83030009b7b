"""How the queries over exploded words and frames are planned: Spark guesses such tables too small, so none may be broadcast."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from tidemark.operators import clips as cl
from tidemark.operators import tokens as tk
from tidemark.plans import catalog

#: Queries whose tables are all words, frames or candidates.
EXPLODED = (
    "audible_edges", "audible_loss", "destretched", "sounding_share", "edge_frames", "word_threshold", "repeat_cut_edges", "retake_pairs", "repeat_candidates", "repeats_detected", "repeat_chain",
)


@pytest.mark.parametrize("name", EXPLODED)
def test_exploded_rows_are_not_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_glossary_windows_are_not_broadcast(spark):
    """Only the terms are, which are few."""
    plan = catalog.QUERIES["glossary_fixes"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 1


CLIPS = "key string, id long, track long, media string, t0 long, t1 long, src_in long, src_out long, speed long"


def test_words_of_tracks(spark):
    """Counts as by making every pair: twins, reversed clips, speeds, words that share times, repeated and missing idx."""
    dice = random.Random(3)
    clips, words = [], []
    for n in range(300):
        a, b = dice.randrange(0, 60), dice.randrange(0, 60)
        clips.append((dice.choice("pqrst"), n, dice.randrange(1, 5), dice.choice(["m1", "m2", "m3", None]), dice.randrange(0, 4) * 10, 100, a, b, dice.choice([None, 0, 1, 2])))
    for n in range(200):
        s0 = dice.randrange(0, 60)
        words.append((dice.choice(["m1", "m2", "m4", None]), dice.choice([None, n // 2, n, n]), s0, s0 + dice.randrange(0, 6)))
    clips, words = spark.createDataFrame(clips, CLIPS), spark.createDataFrame(words, "media string, idx long, s0 long, s1 long")
    pairs = cl.words_on_timeline(words, clips, 1).join(clips.select(F.col("id").alias("clip"), "track"), "clip")
    want = {tuple(r) for r in pairs.groupBy("key", "track").count().collect()}
    assert {tuple(r) for r in cl.words_of_tracks(words, clips).collect()} == want and len(want) > 10


def test_voice_track_counts_without_pairs(spark):
    """A recording of 3,000 words in 3,000 sequences: nine million pairs, which no join of the plan makes."""
    clips = spark.range(3000).select(F.col("id").cast("string").alias("key"), "id", F.lit(1).cast("long").alias("track"), F.lit("m").alias("media"), F.lit(0).alias("t0"), F.lit(9000).alias("t1"), F.lit(0).alias("src_in"), F.lit(9000).alias("src_out"), F.lit(1).alias("speed"))
    words = spark.range(3000).select(F.lit("m").alias("media"), F.col("id").alias("idx"), F.col("id").alias("s0"), (F.col("id") + 1).alias("s1"))
    counts = cl.words_of_tracks(words, clips)
    assert {(r.track, r.n) for r in counts.collect()} == {(1, 3000)} and counts.count() == 3000
    assert cl.voice_track(counts, clips).where("role = 'voice'").count() == 3000


def test_overlay_by_blocks(spark):
    """As frame by frame, with odd speeds and places over the edges of blocks; no frame of the grid is shuffled alone."""
    dice = random.Random(5)
    speeds = (0.0, 0.3, 0.5, 1.0, 1.7, 2.0, 40.0, -1.0, -0.7, None)
    clips = [(dice.choice("ab"), dice.choice(["m1", "m2", "m3"]), t := dice.randrange(-300, 500), t + dice.randrange(-5, 700), dice.randrange(-400, 600), dice.choice(speeds)) for _ in range(120)]
    levels = {(m, i): dice.randrange(-80, 0) for m in ("m1", "m2") for i in range(-700, 1500) if dice.random() < 0.03}
    lengths = {"a": 700, "b": 256, "c": 3, "d": 0}
    want = {(k, i): -90 for k, n in lengths.items() for i in range(n)}
    for key, media, t0, t1, src, speed in clips:
        for i in range(t0, t1) if speed is not None else ():
            v = levels.get((media, src + math.floor((i - t0) * speed)))
            if v is not None and (key, i) in want:
                want[key, i] = max(want[key, i], v)
    df = cl.overlay(
        spark.createDataFrame(clips, "key string, media string, t0 long, t1 long, src_in long, speed double"),
        spark.createDataFrame([(*k, v) for k, v in levels.items()], "media string, i long, v long"), spark.createDataFrame(list(lengths.items()), "key string, n long"), -90,
    )
    rows = df.collect()
    got = {(r.key, r.i): r.v for r in rows}
    assert not [(k, v, want[k]) for k, v in got.items() if v != want[k]][:5]
    assert len(rows) == len(want) and got == want and len(set(want.values())) > 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"hashpartitioning\(key#\w+, i#", plan))) == 1


def test_neighbouring_blocks_take_one_shuffle(spark):
    rows = [("a", p, w) for p, w in enumerate("x y x y z w x".split())] + [("a", 8, "x"), ("b", 0, "x"), (None, 0, "x"), ("c", 0, None), ("c", 2, None), ("c", 3, "x")]
    out = tk.neighbour_overlap(spark.createDataFrame(rows, "key string, pos int, token string"), 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {(r.key, r.b): (r.dot, r.q, r.q2, r.cosine) for r in out.collect()}
    assert got == {("a", 0): (2, 2, 2, 1000), ("a", 1): (0, 2, 2, 0), ("a", 2): (0, 2, 1, 0), ("a", 3): (1, 1, 1, 1000), ("c", 0): (0, 1, 2, 0)}


def test_lexicon_comes_before_the_shuffle(spark):
    """The words are joined to the lexicon below the join that leaves out what is taken."""
    plan = catalog.QUERIES["prioritised_hits"](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join (LeftAnti|LeftOuter|Inner, \(token)", plan)
    assert "Inner, (token" in joins and joins[joins.index("Inner, (token") - 1] == "LeftOuter"
