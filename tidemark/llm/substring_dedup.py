"""Substring dedup: windows of words that repeat, found by level-wise doubling.

A word is removed when it lies in a window of ``window`` consecutive words whose sequence also starts
anywhere else, in the same document or another; windows are judged on the input.

Levels.  The first length is a quarter of the window (9 for 35).  Every window of 35 holds 27 windows of
9, and takes the one with the smallest hash as its anchor: a choice that depends on the window's words
alone, so equal windows have equal anchors and only anchors need be counted (about one word in 14).
Anchors that repeat are extended to twice the length, towards the side on which the window has room;
those that still repeat stay.  Then the windows of a surviving anchor, which are consecutive, are taken
together as one span: a span that repeats whole settles all its windows.  Of each distinct span one
representative is opened into single windows of the full length, and these are counted.  Nothing is left
to extend after that.

Copies cost little: equal spans are opened once.  Counts are partial sums before any shuffle; joins back to
rows have both sides shuffled for the join alone, so adaptive execution can split a frequent key.

Hashes: 64 bits per level, 128 at the last, from independent bases; a wrong removal needs collisions at
all levels at once.  Texts are identified by two 64-bit hashes.  Null and empty texts have no words; texts
shorter than the window keep all words.  Rows with the same text have the same result, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, mixed, window_hashes, word_hashes, words, written

KEYS = ("k1", "k2")


def anchors_of(hashes: np.ndarray, window: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(h, a): hashes of the first level's windows, and for each full window the start of its anchor."""
    h = window_hashes(hashes, first)
    span = window - first + 1
    if len(h) < span:
        return h, np.empty(0, np.int64)
    return h, np.arange(len(h) - span + 1) + np.argmin(sliding_window_view(h, span), axis=1)


def spans_of(anchor: np.ndarray, window: int, second: int, first: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor and one side: (anchor, extended start, first window, last window)."""
    i = np.arange(len(anchor))
    start = np.where(anchor + second <= i + window, anchor, anchor + first - second)
    new = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(start) != 0)]) if len(i) else i
    last = np.r_[new[1:], len(i)] - 1 if len(i) else i
    return anchor[new], start[new], new, last


def repeating(rows: DataFrame, keys: list[str], label: str, keep: Scratch) -> DataFrame:
    """The rows whose keys occur at least twice."""
    several = keep.written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys), label)
    return rows.join(several, keys, "left_semi")


def removed_spans(base: DataFrame, window: int, keep: Scratch) -> DataFrame:
    """(k1, k2, spans): for texts (text, k1, k2) that lose words, the first and last windows of each removed run."""
    first, second = -(-window // 4), min(window, 2 * -(-window // 4))

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(c).to_numpy() for c in KEYS)
            hs, rows, at = [], [], []
            for r, t in enumerate(b.column("text")):
                h, a = anchors_of(word_hashes(words(t.as_py())), window, first)
                a = np.unique(a)
                hs.append(h[a])
                at.append(a)
                rows.append(np.full(len(a), r))
            rows = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.concatenate(hs) if hs else np.empty(0, np.uint64)).view(np.int64)),
                    pa.array(k1[rows]), pa.array(k2[rows]), pa.array((np.concatenate(at) if at else rows).astype(np.int32)),
                ],
                names=["h", *KEYS, "at"],
            )

    found = keep.written(base.select("text", *KEYS).mapInArrow(first_level, "h long, k1 long, k2 long, at int"), "op10-anchors")
    kept = repeating(found, ["h"], "op10-first", keep).groupBy(*KEYS).agg(F.collect_set("at").alias("ats"))
    kept = keep.written(kept, "op10-kept")

    def second_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(c).to_numpy() for c in KEYS)
            out = [[] for _ in range(5)]
            for r, (t, ats) in enumerate(zip(b.column("text"), b.column("ats"))):
                hashes = word_hashes(words(t.as_py()))
                _, a = anchors_of(hashes, window, first)
                anchor, start, lo, hi = spans_of(a, window, second, first)
                keep = np.isin(anchor, np.array(ats.as_py()))
                anchor, start, lo, hi = (x[keep] for x in (anchor, start, lo, hi))
                # a span's hash: the sequence from its first window's start to its last one's end, and the anchor's place
                length = hi - lo + window
                span = np.empty(len(lo), np.uint64)
                for n in np.unique(length):
                    same = length == n
                    span[same] = mixed(window_hashes(hashes, int(n))[lo[same]] ^ mixed((anchor - lo)[same].astype(np.uint64) + np.uint64(1)))
                h = window_hashes(hashes, second)[start]
                for o, x in zip(out, (np.full(len(lo), r), h, span, lo, hi)):
                    o.append(x)
            rows, h, span, lo, hi = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
            rows = rows.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.astype(np.uint64).view(np.int64)), pa.array(span.astype(np.uint64).view(np.int64)), pa.array(k1[rows]),
                    pa.array(k2[rows]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                ],
                names=["h", "span", *KEYS, "lo", "hi"],
            )

    extended = base.select("text", *KEYS).join(kept, list(KEYS)).select("text", *KEYS, "ats")
    extended = keep.written(extended.mapInArrow(second_level, "h long, span long, k1 long, k2 long, lo int, hi int"), "op10-spans")
    extended = keep.written(repeating(extended, ["h"], "op10-second", keep), "op10-doubled")
    spans = keep.written(
        extended.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEYS, "lo", "hi")).alias("one")), "op10-distinct"
    )
    whole = extended.join(spans.where("n > 1").select("span"), "span", "left_semi").select(*KEYS, "lo", "hi")
    ones = spans.select("one.*").groupBy(*KEYS).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    ones = keep.written(ones, "op10-ones")

    def last_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(c).to_numpy() for c in KEYS)
            out = [[] for _ in range(4)]
            for r, (t, spans) in enumerate(zip(b.column("text"), b.column("spans"))):
                hashes = word_hashes(words(t.as_py()))
                at = np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans.as_py()]))
                for o, x in zip(out, (np.full(len(at), r), window_hashes(hashes, window)[at], window_hashes(hashes, window, 1)[at], at)):
                    o.append(x)
            rows, h, g, at = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
            rows = rows.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.astype(np.uint64).view(np.int64)), pa.array(g.astype(np.uint64).view(np.int64)),
                    pa.array(k1[rows]), pa.array(k2[rows]), pa.array(at.astype(np.int32)),
                ],
                names=["h", "g", *KEYS, "lo"],
            )

    # one row per distinct text that holds a representative: its copies would make every window repeat
    texts = base.select("text", *KEYS).join(ones, list(KEYS)).dropDuplicates(list(KEYS))
    singles = keep.written(texts.select("text", *KEYS, "spans").mapInArrow(last_level, "h long, g long, k1 long, k2 long, lo int"), "op10-windows")
    single = repeating(singles, ["h", "g"], "op10-last", keep).select(*KEYS, "lo", F.col("lo").alias("hi"))
    removed = whole.unionByName(single)
    return removed.groupBy(*KEYS).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (kept words joined by one space)."""
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("_id"), text.alias("text")).withColumns(
        {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(window), "text", F.length("text"))}
    )
    with Scratch(docs.sparkSession, "op10") as keep:
        removed = written(removed_spans(base, window, keep), "op10-removed")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals, gone, texts = [], [], []
            for t, spans in zip(b.column("text"), b.column("spans")):
                tokens = words(t.as_py())
                if spans.is_valid:
                    edges = np.zeros(len(tokens) + 1, np.int64)
                    for s in spans.as_py():
                        edges[s["lo"]] += 1
                        edges[s["hi"] + window] -= 1
                    keep = np.cumsum(edges[:-1]) == 0
                    kept_words = [w for w, k in zip(tokens, keep.tolist()) if k]
                else:
                    kept_words = tokens
                totals.append(len(tokens))
                gone.append(len(tokens) - len(kept_words))
                texts.append(b" ".join(kept_words).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                names=[id_col, "n_words", "n_removed", "kept_text"],
            )

    joined = base.join(removed, list(KEYS), "left").select("_id", "text", "spans")
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """repeated_substrings with the kept text's SHA-256 instead of the text."""
    rows = repeated_substrings(docs, id_col, text_col, window)
    return rows.select(F.col(id_col), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
