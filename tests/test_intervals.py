"""Interval algebra on literals, and on random intervals against sets of whole units."""

import random

import pytest

from tidemark.operators import intervals as iv


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, t0 long, t1 long")


def found(df):
    return sorted(tuple(r) for r in df.select("key", "t0", "t1").collect())


def units(rows, key):
    return {u for k, a, b in rows if k == key and a is not None and b is not None for u in range(a, b)}


def pieces(cover):
    out = []
    for u in sorted(cover):
        if out and out[-1][1] == u:
            out[-1][1] = u + 1
        else:
            out.append([u, u + 1])
    return out


def test_merge_drops_empty_reversed_and_null(spark):
    rows = [("a", 3, 4), ("a", 1, 2), ("a", 2, 3), ("a", 5, 5), ("a", 6, 5), (None, 1, 2), ("b", None, 3)]
    assert found(iv.islands(table(spark, rows))) == [("a", 1, 4)]


def test_gap_is_strict(spark):
    rows = [("a", 0, 1), ("a", 3, 4), ("a", 5, 6)]
    assert found(iv.islands(table(spark, rows), 2)) == [("a", 0, 1), ("a", 3, 6)]


def test_subtract_literal(spark):
    a, b = table(spark, [("k", 0, 10)]), table(spark, [("k", 1, 2), ("k", 5, 6), ("k", 9, 12)])
    assert found(iv.subtract(a, b)) == [("k", 0, 1), ("k", 2, 5), ("k", 6, 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_units(spark, seed):
    rng = random.Random(seed)
    make = lambda: [(rng.choice("ab"), a := rng.randrange(60), a + rng.randrange(-2, 9)) for _ in range(25)]
    x, y = make(), make()
    dx, dy = table(spark, x), table(spark, y)
    cases = {"union": (iv.union(dx, dy), set.union), "intersect": (iv.intersect(dx, dy), set.intersection), "subtract": (iv.subtract(dx, dy), set.difference)}
    for name, (df, op) in cases.items():
        want = [(k, *p) for k in "ab" for p in pieces(op(units(x, k), units(y, k)))]
        # adjacent results stay apart only where one of the inputs ends between them
        assert units(found(df), "a") == {u for k, s, e in want if k == "a" for u in range(s, e)}, name
        assert units(found(df), "b") == {u for k, s, e in want if k == "b" for u in range(s, e)}, name


def test_buckets_do_not_change_pairs(spark):
    x = table(spark, [("k", i, i + 7) for i in range(0, 40, 3)])
    pairs = lambda n: sorted(tuple(r) for r in iv.overlapping(x, x, n).collect())
    assert pairs(1) == pairs(5) == pairs(1000)


def test_ripple_literal(spark):
    removed = table(spark, [("k", 5, 7), ("k", 2, 3)])
    at = spark.createDataFrame([("k", i, t) for i, t in enumerate([1, 2, 3, 4, 6, 8])], "key string, id long, t long")
    assert [r.t_new for r in iv.ripple(at, removed).orderBy("id").collect()] == [1, 2, 2, 3, 4, 5]


def test_empty_tables(spark):
    none = table(spark, [])
    for df in (iv.islands(none), iv.subtract(none, none), iv.intersect(none, none), iv.total(none), iv.frames(none, 10, "inner")):
        assert df.count() == 0
