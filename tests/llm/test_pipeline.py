"""Every stage of the pipeline against brute force on its own input."""

import pytest

import corpus_pipeline
from tests.conftest import TINY
from tests.llm.data import documents, frame, labels
from tests.llm.test_documents import result, slow_components
from tidemark.llm import mixing, packing, pii
from tidemark.llm.common import clean, numbered_in_order, with_position, written


def test_stages(spark, tmp_path):
    rows = documents(seed=11, n=48)
    labels(spark, rows).write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and set(result(kept)) <= set(result(docs)) and 0 < kept.count() < docs.count()

    # one row of each component: ids that are their component's smallest, and all rows without words
    found = {(i,) for i, n, c in slow_components(rows) if n and i == c}
    blank = [(r[0],) for r in rows if not (r[1] or "").split()]
    single = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert single.columns == docs.columns and result(single.select("doc_id")) == sorted([*found, *blank], key=repr)

    clean = corpus_pipeline.pii_redaction(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(map(repr, (r.text for r in clean.collect()))) == sorted(repr(pii.redact(r[1])) for r in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())

    mixed = corpus_pipeline.source_mixing(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and result(mixed) == result(docs)

    batches = corpus_pipeline.length_packing(spark, docs, str(tmp_path))
    own = [c for c in docs.columns if c != "bucket"]  # a column named like one of the stage's gives way
    assert result(batches.select(*own)) == result(docs.select(*own)) and len(batches.columns) == len(docs.columns) + 5
    assert all(r.n_tokens == len((r.text or "").split()) for r in batches.collect())


def test_rows_of_partition_folders_keep_their_places(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", "abc"[i % 3], 1, 1, "h", "s", "b") for i in range(300)]
    frame(spark, rows).coalesce(1).write.partitionBy("source").parquet(f"{tmp_path}/parts")
    shuffled = frame(spark, rows).repartition(5, "doc_id").where("doc_id >= 0")
    for docs in (spark.read.parquet(f"{tmp_path}/parts"), shuffled, shuffled.unionByName(shuffled)):
        out = packing.packed_rows(docs).collect()
        assert len(out) == docs.count() and all(r.n_tokens == len(r.text.split()) for r in out)


def test_scratch_tables_can_be_removed(spark):
    table = written(frame(spark), "test-clean")
    assert table.count() > 0 and clean(spark) >= 1
    assert clean(spark) == 0
    with pytest.raises(Exception):
        table.collect()


def test_run(spark):
    out = corpus_pipeline.run(spark, TINY)
    ids = [r.doc_id for r in out.collect()]
    assert 0 < len(ids) == len(set(ids)) < spark.read.parquet(f"{TINY}/documents.parquet").count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "packing"]


def test_batches_follow_the_mixed_order(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", "ab"[i >= 200], 1, 1, "h", "s", "b") for i in range(300)]
    docs = frame(spark, rows)
    rank = {r.doc_id: r.mix_rank for r in mixing.mixed_order(docs).collect()}
    at = [name for name, _ in corpus_pipeline.STAGES].index("PII")
    for _, stage in corpus_pipeline.STAGES[at:]:
        docs = written(stage(spark, docs, str(tmp_path)), "test-stage")
    buckets = {}
    for r in docs.collect():
        buckets.setdefault(r.bucket, []).append((r.batch, r.place, rank[r.doc_id]))
    assert len(buckets) == 8 and sum(map(len, buckets.values())) == len(rows)
    for found in buckets.values():
        ranks = [r for _, _, r in sorted(found)]
        assert ranks == sorted(ranks)


def test_numbers_in_written_order(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("999 - id as id", "id % 3 as g").orderBy("id")
    for slice_rows in (10_000, 9):
        out = numbered_in_order(with_position(written(df, "test-order")), "g", "n", slice_rows=slice_rows).collect()
        for g in range(3):
            assert [r.id for r in sorted((r for r in out if r.g == g), key=lambda r: r.n)] == sorted(r.id for r in out if r.g == g)
            assert sorted(r.n for r in out if r.g == g) == list(range(sum(r.g == g for r in out)))


def test_near_duplicates_by_row(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    texts = [
        (None, a), (None, a), (None, a + " end"),  # a group of null ids: one stays
        (None, "unique without an id"), (None, None), (None, " "),  # all stay
        (1, b), (1, c), (1, c),  # one id, two texts: both stay once
        (2, d), (5, d + " end"), (5, "another text of five"),  # 5 is a near copy of 2 in one of its rows only
        (7, c + " end"),  # a near copy of c
        (8, ""), (9, None),
    ]
    docs = frame(spark, [(i, t, "en", "s", 1, 1, "h", "s", "b") for i, t in texts])
    single = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in single.collect()), key=repr)
    of_a = [x for x in got if x[1] and x[1].startswith("a0 ")]
    assert len(of_a) == 1 and of_a[0] in texts[:3]
    want = [(None, "unique without an id"), (None, None), (None, " "), (1, b), (1, c), (2, d), (5, "another text of five"), (8, ""), (9, None)]
    assert sorted(set(got) - set(of_a), key=repr) == sorted(want, key=repr) and len(got) == len(want) + 1
