"""Sharding, importance resampling and fill-in-the-middle against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from tests.llm.data import documents, frame
from tidemark.llm import fill_in_middle as fim
from tidemark.llm import importance, queries, sharding


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- sharding ------------------------------------------------------------------------------------


def slow_shards(rows, shards):
    """(id, size, crc, shard, slot) by one sort of everything."""
    hexed = lambda x: hashlib.md5(x.encode()).hexdigest()[:16]
    rows = sorted(rows, key=lambda r: (hexed(r[1] or ""), hexed("" if r[0] is None else str(r[0]))))
    sizes = [len((r[1] or "").encode()) + 1 for r in rows]
    out, at, slots = [], 0, Counter()
    for r, size in zip(rows, sizes):
        shard = (2 * at + size) * shards // (2 * sum(sizes))
        out.append((r[0], size, zlib.crc32((r[1] or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        at += size
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards, rows_a_range", [(16, 500_000), (3, 2), (1, 10)])
def test_shards_equal_one_sort(spark, shards, rows_a_range):
    rows = documents()
    rows += [(1000 + i, "a hot copy of one text", *rows[0][2:]) for i in range(60)] + [rows[1]] * 30
    out = sharding.sharded(frame(spark, rows), shards=shards, rows_a_range=rows_a_range)
    assert result(out.select("doc_id", "size", "text_crc32", "shard", "slot")) == slow_shards(rows, shards)
    assert {(r.law, r.grown_shard) for r in out.collect()} == {("bytes", None)}
    held = Counter()
    for r in out.collect():
        held[r.shard] += r["size"]
    largest = max(r["size"] for r in out.collect())
    assert all(abs(held[s] - sum(held.values()) / shards) <= largest for s in range(shards))


def test_overfull_ranges_are_subdivided(spark):
    # a poor first sample: all of the first splitters fall into one end of the keys
    rows = [(i, "x" * (i % 7) + str(i), "", "", 1, 1, "", "", "") for i in range(600)] + [(7, "same", "", "", 1, 1, "", "", "")] * 400
    keyed = sharding.written(sharding._keyed(frame(spark, rows), "doc_id", "text"), "test")
    total, n = keyed.agg(F.sum("size"), F.count("size")).first()
    bounds = sharding.splitters(keyed, 16, total, n)
    assert bounds == sorted(set(bounds)) and all(len(b) == sharding.KEY for b in bounds)
    counts = keyed.groupBy(sharding.range_number(F.col("_key"), bounds).alias("r")).agg(F.sum(F.col("size") + total // n).alias("load")).collect()
    assert max(r.load for r in counts) <= 3 * 2 * total / 16 + 20 and len(counts) == len(bounds) + 1


def test_range_number(spark):
    keys = [bytes([i]) + b"\0" * 23 for i in (0, 3, 100, 200, 255)]
    for some in (keys, keys[:1], []):
        df = spark.createDataFrame([(bytearray(bytes([i]) + b"\0" * 23),) for i in range(256)], "k binary")
        got = [r.n for r in df.select(sharding.range_number(F.col("k"), some).alias("n")).collect()]
        assert got == [sum(k[0] <= i for k in some) for i in range(256)]


def test_no_documents(spark):
    none = frame(spark, [])
    assert sharding.sharded(none).collect() == []
    assert importance.resampled(none, none.select("text")).collect() == []
    assert importance.resampled_rows(none, none.select("text")).collect() == []
    assert fim.digests(none).collect() == []


# ---- importance resampling -----------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % 10000 for r in runs]


def slow_draw(rows, target):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(slow_features(r[1])[1])
    for x in target:
        t.update(slow_features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in set(s)}
    out = []
    for i, text, *_ in rows:
        n, found = slow_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((n, i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    return out, able


def test_features_equal_the_joined_runs():
    texts = ["", "A", "one two", "É ÀB c9\x00d_e—f", "x" * 64 + " y " + "z" * 65 + " " + "q" * 500 + " a b", "ñandú " * 40, "a-b'c 1.2", "é" * 33 + " b"]
    for t in texts:
        n, want = slow_features(t)
        got = importance.words(t)
        assert len(got) == n and sorted(importance.features(got).tolist()) == sorted(want)


@pytest.mark.parametrize("percent", [0, 5, 37, 100])
def test_draw_equals_one_sort(spark, percent):
    rows = documents()
    target = ["the a w1 w2 w3", None, "", "ñandú w5 w6 w7 w8 w9"]
    scored, able = slow_draw(rows, target)
    table = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resampled(frame(spark, rows), table, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in out), key=repr) == sorted((r[1:] for r in scored), key=repr)
    k = percent * len(able) // 100
    assert [(r.doc_id, r.score) for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])] == [(r[1], r[4]) for r in able[:k]]
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, k + 1))
    kept = importance.resampled_rows(frame(spark, rows), table, percent=percent).collect()
    assert [(r.doc_id, r["rank"]) for r in kept] == [(r[1], i + 1) for i, r in enumerate(able[:k])] and all(r.text for r in kept)


def test_kth_key(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)) << 40, int(rng.integers(0, 2)), int(rng.integers(0, 2**62)) if i % 2 else 5, i << 33) for i in range(80)]
    df = spark.createDataFrame(rows, ", ".join(f"{p} long" for p in importance.PARTS))
    for k in (1, 2, 33, 79, 80):
        assert importance.kth_key(df, k) == list(sorted(rows)[k - 1])
    assert importance.kth_key(df, 0) is None


# ---- fill in the middle --------------------------------------------------------------------------

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def slow_fim(doc_id, text):
    text = text or ""
    u, digest = UNIT.findall(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)], len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TRICKY = ["<", "<P", "<P>", "a<S>b", "<<M>", "<PP>", "P>", "<p>", "<é>", "é<P>é", "<P<S", "S>M>", "ab1cd <P >", "日本x語", "́a", "a\nb", "<>" * 5, "<M", "𝒳<S", "<SP>"]


def test_units_and_forms():
    for block in (1, 2, 3, 7, 1 << 20):
        before, fim.BLOCK = fim.BLOCK, block
        try:
            for i, text in enumerate([*TRICKY, "", "x" * 40, *(r[1] for r in documents(n=6))]):
                form, n, prefix, middle, output = fim.transform((text or "").encode(), fim.draws(i))
                assert (n, form, prefix, middle, output.decode()) == slow_fim(i, text), (block, text)
                assert fim.restore(output, form).decode() == (text or "")
        finally:
            fim.BLOCK = before


def test_restore_refuses_other_outputs():
    for output, form in ((b"abc", "psm"), (b"<P>a<M>b<S>c", "psm"), (b"<P>a<S>b", "psm"), (b"<P>a<S>b<M>c", "spm"), (b"x", "other")):
        with pytest.raises(ValueError):
            fim.restore(output, form)


def test_fim_rows(spark):
    rows = documents() + [(2000 + i, t, "", "", 1, 1, "", "", "") for i, t in enumerate(TRICKY * 8)]
    want = [(r[0], *slow_fim(r[0], r[1])) for r in rows]
    out = fim.restored(fim.transformed(frame(spark, rows)))
    assert result(out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) == sorted(
        ((i, n_, *rest) for i, n_, *rest in want), key=repr
    )
    assert all(r.restored == (r.text or "") for r in out.collect())
    assert "source" in out.columns and out.columns.count("n") == 1
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert result(fim.digests(frame(spark, rows))) == sorted(((i, n, f, p, m, sha(o), sha(r[1] or "")) for r, (i, n, f, p, m, o) in zip(rows, want)), key=repr)


def test_fim_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{TINY}/documents.parquet'")
    cursor = con.execute(queries.OP13_SQL)
    names = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    assert result(queries.op13_fill_in_middle(spark, TINY).select(*names)) == want
