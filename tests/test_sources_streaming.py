"""Timeline files, text sinks and streams."""

import json
import os

from pyspark.sql import functions as F

from tidemark.operators import sequences as sq
from tidemark.sources import timeline
from tidemark.streaming import spans

SEQUENCE = {
    "id": "s1", "fps": 25.0, "inPoint": 1.5, "outPoint": "-400000", "extra": 1,
    "video": [{"idx": 3, "clips": [{"name": "b", "media": "m.mp4", "start": 5, "end": 9, "inPoint": 1, "out": 5, "speed": 0}, {"name": "a", "path": "p.mp4", "start": 0, "end": 5, "in": 0, "out": 10, "speed": 2.0}]}],
    "audio": [{"muted": True, "clips": [{"name": "c", "path": "p.wav", "start": 0, "end": 7}]}, {"clips": []}],
}


def test_timeline_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(SEQUENCE))
    (tmp_path / "b.json").write_text("{}")
    seq = timeline.read(spark, str(tmp_path))
    rows = {r.name: r for r in timeline.clips(seq).collect()}
    assert [(rows[n].track, rows[n].clip, rows[n].path, rows[n].speed, rows[n].src_in) for n in "abc"] == [(3, 0, "p.mp4", 2.0, 0.0), (3, 1, "m.mp4", 1.0, 1.0), (0, 0, "p.wav", 1.0, None)]
    one = timeline.summaries(seq).where("id = 's1'").first()
    assert (one.in_point, one.out_point, one.duration) == (1.5, None, 9.0)
    assert sorted(r.name for r in timeline.audible(timeline.clips(seq)).collect()) == ["a", "b"]


def test_text_sink(spark, tmp_path):
    df = spark.createDataFrame([("k", 2, "two"), ("k", 1, "one"), ("j", 1, None)], "key string, n int, line string")
    timeline.write_texts(df, f"{tmp_path}/out", "line", ["n"])
    (part,) = (f for f in os.listdir(f"{tmp_path}/out/key=k") if f.endswith(".txt"))
    assert open(f"{tmp_path}/out/key=k/{part}").read() == "one\ntwo\n"


def stream(spark, df, tmp_path, query, mode):
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = query(source).writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").queryName("found")
    q = q.option("path", f"{tmp_path}/out") if mode == "append" else q
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out") if mode == "append" else spark.table("found")


def test_stream_sessions_equal_batch(spark, tmp_path):
    rows = [("a", 0, 10), ("a", 15, 5), ("a", 100, 1), ("b", 0, 3), ("b", 4, 50), ("b", 40, 1)]
    df = spark.createDataFrame(rows, "key string, s long, seconds long").select("key", F.timestamp_seconds("s").alias("at"), "seconds")
    want = sorted(map(tuple, spans.sessions(df, 10).collect()))
    assert sorted(map(tuple, stream(spark, df, tmp_path, lambda x: spans.sessions(x, 10), "complete").collect())) == want
    assert [(k, n) for k, _, _, n, _ in want] == [("a", 2), ("a", 1), ("b", 3)]


def test_stream_label_changes(spark, tmp_path):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate("xxyyx")] + [("b", 0, "z")], "key string, i long, label string")
    got = sorted(map(tuple, stream(spark, df, tmp_path, spans.label_changes, "append").collect()))
    assert got == [("a", 0, "x"), ("a", 2, "y"), ("a", 4, "x"), ("b", 0, "z")]


def test_stream_label_changes_with_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, None), ("a", 2, "x"), ("a", 3, None)], "key string, i long, label string")
    assert sorted((r.i, r.label) for r in stream(spark, df, tmp_path, spans.label_changes, "append").collect()) == [(0, None), (2, "x"), (3, None)]


def test_pages(spark):
    text = spark.createDataFrame([("k", i, w) for i, w in enumerate("aa bb cccc dddddddd e".split())], "key string, pos int, token string")
    assert [(r.page, r.line, r.text) for r in sq.pages(text, 5, 2).orderBy("p0").collect()] == [(0, 0, "aa bb"), (0, 1, "cccc"), (1, 0, "dddddddd"), (1, 1, "e")]


def test_viterbi_is_the_best_path(spark):
    import itertools
    import random

    rng = random.Random(2)
    x = [[rng.random() * 2 for _ in range(2)] for _ in range(9)]
    value = lambda p: sum(x[t][s] for t, s in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(2), repeat=9), key=value)
    df = spark.createDataFrame([("k", i, *v) for i, v in enumerate(x)], "key string, i long, p double, q double")
    assert [r.label for r in sq.viterbi(df, ["p", "q"], 0.8).orderBy("i").collect()] == ["pq"[s] for s in best]


def test_state_machines(spark):
    frames = spark.createDataFrame([("k", i, x) for i, x in enumerate("aaabaaabbbb")], "key string, i long, label string")
    assert [tuple(r)[1:] for r in sq.shots(frames, 2, 3).orderBy("i0").collect()] == [("a", 0, 7), ("b", 7, 11)]
    rows = spark.createDataFrame([("k", t, "c") for t in (0, 31, 37, 95, 150, 158, 240, 301)], "key string, t long, title string")
    ts = [r.t for r in sq.merged_to_count(rows, 5, 20).orderBy("t").collect()]
    assert len(ts) <= 5 and ts[0] == 0 and all(b - a >= 20 for a, b in zip(ts, ts[1:]))
    line = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([0, 1, 2, 3, 0, 0])], "key string, i long, v double")
    assert [r.i for r in sq.simplified(line, 0.1).orderBy("i").collect()] == [0, 3, 4, 5]
    assert sq.shots(frames.limit(0), 2, 3).count() == 0


def test_caches_libraries_and_single_clips(spark, tmp_path):
    for name, text in {
        "a.json": "\ufeff" + '{"v": 3, "hash": "h1", "model": "m", "lang": "id", "words": [{"text": " hi", "start": 0.5, "end": 0.9, "seg_end": 1}, {"text": "yo", "start": 1.0, "end": 1.2}]}',
        "old.json": '{"v": 2, "hash": "h2", "words": [{"text": "x", "start": 0, "end": 1}]}', "bad.json": "{not json",
    }.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    media = spark.createDataFrame([("m1", "h1"), ("m2", "h2"), ("m3", "h3")], "path string, hash string")
    found = timeline.cached_words(spark, str(tmp_path), media, 3).orderBy("n").collect()
    assert [(r.path, r.n, r.text, r.seg, r.prob) for r in found] == [("m1", 0, " hi", True, 1.0), ("m1", 1, "yo", False, 1.0)]
    assert timeline.cached_words(spark, str(tmp_path), media, 3, model="other").count() == 0
    (tmp_path / "lib" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "lib" / ".trash").mkdir()
    for name in ("lib/b.MP4", "lib/a.png", "lib/c.txt", "lib/deep/d.mp4", "lib/deep/er/e.mp4", "lib/.trash/f.mp4"):
        (tmp_path / name).write_bytes(b"xy")
    got = [r.file for r in timeline.library(spark, f"{tmp_path}/lib", ("mp4", "png"), 1).orderBy("file").collect()]
    assert got == ["a.png", "b.MP4", "deep/d.mp4"]
    clip = timeline.of_media(spark.createDataFrame([("/x/y.mp4", 12.5)], "path string, duration double")).first()
    assert (clip.name, clip.t0, clip.t1, clip.speed) == ("y.mp4", 0.0, 12.5, 1.0)
