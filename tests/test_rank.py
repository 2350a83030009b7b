"""Folds against plain loops."""

import random

from tidemark.operators import rank, series


def test_merge_close_keeps_by_last_kept(spark):
    ts = [0, 4, 6, 11, 12, 30]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(ts)], "key string, id long, t long")
    assert sorted(r.t for r in rank.merge_close(df, 6).collect()) == [0, 6, 12, 30]


def test_nms_literal(spark):
    df = spark.createDataFrame([("k", 1, 0, 30, 50), ("k", 2, 5, 35, 70), ("k", 3, 40, 60, 40)], "key string, id long, t0 long, t1 long, score long")
    assert sorted(r.score for r in rank.suppressed(df).collect()) == [40, 70]


def test_budget(spark):
    rng = random.Random(3)
    ts = sorted(rng.randrange(200) for _ in range(60))
    kept = []
    for t in ts:
        if sum(t - k < 20 for k in kept) < 3:
            kept.append(t)
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(ts)], "key string, id long, t long")
    assert sorted(r.t for r in rank.budgeted(df, 20, 3).collect()) == kept


def test_gate_and_runs(spark):
    v = [0, 5, 9, 5, 0, 5, 5, 0]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "key string, i long, v long")
    assert [tuple(r) for r in series.gate(df, 5, 9).collect()] == [("k", 1, 4)]
    assert sorted((r.i0, r.i1) for r in series.runs(df, df["v"] >= 5).collect()) == [(1, 4), (5, 7)]
    assert [(r.i0, r.i1) for r in series.runs(df, df["v"] >= 5, max_gap=1).collect()] == [(1, 7)]
