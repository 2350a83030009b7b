"""Small literal cases of zooms, camera states, amounts, judgements and edits; empty tables and nulls."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import camera as cm
from tidemark.operators import usage as us

KEYS = "key long, n long, t long, s double, cx double, cy double, ease string"
WORDS = "key long, n long, text string, t0 long, t1 long, seg boolean"


def test_camera_stands_still_outside_its_keys(spark):
    keys = spark.createDataFrame([(1, 0, 100, 1.0, 0.5, 0.5, "even"), (1, 1, 200, 2.0, 0.25, 0.75, "even")], KEYS)
    points = spark.createDataFrame([(1, 1, 50), (1, 2, 100), (1, 3, 150), (1, 4, 200), (1, 5, 900), (2, 6, 10)], "key long, id long, t long")
    found = {r.id: (r.s, r.cx, r.cy) for r in cm.camera_states(points, keys).collect()}
    assert found[1] == found[2] == (1.0, 0.5, 0.5)
    assert found[3] == pytest.approx((1.5, 0.5 - 0.25 / 1.5, 0.5 + 0.25 / 1.5))
    assert found[4] == found[5] == (2.0, 0.25, 0.75)
    assert found[6] == (None, None, None)


def test_second_key_of_one_time_wins(spark):
    keys = spark.createDataFrame([(1, 0, 0, 1.0, 0.5, 0.5, "even"), (1, 1, 100, 1.5, 0.5, 0.5, "even"), (1, 2, 100, 3.0, 0.5, 0.5, "even"), (1, 3, 200, 3.0, 0.5, 0.5, "even")], KEYS)
    points = spark.createDataFrame([(1, 1, 100)], "key long, id long, t long")
    assert cm.camera_states(points, keys).first().s == 3.0


def test_ease_ends_at_one(spark):
    kinds = spark.createDataFrame([(k,) for k in ("smooth", "out", "in", "back", "even", None)], "k string")
    for u, want in ((0.0, 0.0), (1.0, 1.0), (7.0, 1.0), (-1.0, 0.0)):
        assert all(abs(r[0] - want) < 1e-12 for r in kinds.select(cm.eased(F.lit(u), F.col("k"))).collect())


def test_amounts(spark):
    words = spark.createDataFrame([(1, i, t) for i, t in enumerate(["50", "thousand.", "1,5", "million", "1,0000005", "thousand", "EUR15.000,", "7,", "thousand", None])], "key long, n long, text string")
    assert [tuple(r) for r in us.amounts(words, {"thousand": 1000, "million": 1_000_000}, "EUR").orderBy("n").collect()] == [
        (1, 0, 2, "50.000."), (1, 2, 2, "1.500.000"), (1, 6, 1, "EUR 15.000,"),
    ]


def judge(spark, said, at):
    words = spark.createDataFrame([(1, i, t, False) for i, t in enumerate(said.split())], "key long, n long, text string, seg boolean")
    r = us.judged(words, F.col("n") == at, ("you",), ("such",), ("off",), ("damn",), ("zoo", "feed"), lambda k: F.array(k), "s").first()
    return r.insult, r.plain, r.swear


def test_judgement_by_context(spark):
    assert judge(spark, "we saw you pig", 3) == (3, 0, True)
    assert judge(spark, "feed the pig at the zoo", 2) == (0, 2, False)
    assert judge(spark, "pig!", 0) == (4, 0, True)
    assert judge(spark, "go, piiig off now", 1) == (4, 0, True)  # a stretched letter, and the word behind it
    assert judge(spark, "the zoo, pig here", 2) == (0, 0, False)  # the mark ends the clause


def test_span_edits(spark):
    words = spark.createDataFrame([(1, i, f"w{i}", i * 100, i * 100 + 80, i == 2) for i in range(6)], WORDS)
    edits = spark.createDataFrame([(1, 1, 2, "abc d"), (1, 3, 3, "x yyy"), (1, 5, 5, "")], "key long, first long, last long, new string")
    assert [tuple(r)[1:] for r in us.span_edits(words, edits).orderBy("n").collect()] == [
        (0, "w0", 0, 80, False), (1, "abc", 100, 180, False), (2, "d", 200, 280, True), (3, "x", 300, 320, False), (4, "yyy", 320, 380, False), (5, "w4", 400, 480, False),
    ]


def test_line_keyword_prefers_digits_and_names(spark):
    words = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(["Elephants", "in", "Paris", "route66"])] + [(1, 1, 9, "a")], "key long, line long, n long, text string")
    assert [tuple(r) for r in us.line_keywords(words, ("none",)).collect()] == [(1, 0, 3, "route66")]


def test_empty_and_null(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert cm.camera_states(none("key long, id long, t long"), none(KEYS)).count() == 0
    assert cm.rhythm(none("key long, n long, t0 long, t1 long"), none("key long, t long"), none("key long, t long")).count() == 0
    assert us.span_edits(none(WORDS), none("key long, first long, last long, new string")).count() == 0
    assert us.amounts(none(WORDS), {"k": 1}, "EUR").count() == 0
    assert us.speech_spans(*[none("key long, id long, t0 long, t1 long")] * 3, 10, 10).count() == 0
    null = spark.createDataFrame([(1, 0, None, None, None, None)], WORDS)
    assert [r.text for r in us.span_edits(null, none("key long, first long, last long, new string")).collect()] == [None]
    assert us.line_keywords(null.withColumn("line", F.lit(0)), ("none",)).count() == 0
    assert us.judged(null, F.col("n") == 0, ("a",), ("a",), ("a",), ("a",), ("a",), lambda k: F.array(k), "s").count() == 1
    assert us.slot_scores(null, ("none",), ("a",), ("b",)).count() == 0
    row = spark.range(1).select(us.advice(F.lit(None).cast("double"), F.lit(-30.0), F.lit(None).cast("double")).alias("a")).first()
    assert row.a == ["quiet"]
    boxes = spark.createDataFrame([(1, 0, None, None, None, None, None, None, None)], "key long, t long, x long, y long, w long, h long, px long, cursor boolean, ignored boolean")
    assert cm.activity_weight(boxes).first().weight == 0.0
