"""Quality rules: fixed base limits, then gradient-boosted trees over document statistics.

The boosted trees are flattened into numpy node arrays that score Arrow batches of statistics without a
loop over rows.  Chosen features are constrained to be monotone: more symbols, repeated words, repeated
lines, shouting or pipes never raise a document's score.

Null and empty texts have zero statistics, so they fail the base limits and are not kept.  Without labels
the trees are empty and a document is kept when it passes the base limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_stats import FEATURES, feature_columns, feature_matrix, with_counts
from tidemark.llm.training import MAX_LABELLED, labelled_sample
from tidemark.llm.trees import Tree, boost

#: Features whose rise never raises the score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "bang_share", "pipe_share", "same_next_share", "upper_share")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Base limits: fewest words, and most words in repeated windows as a percentage.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


class Forest:
    """All trees' nodes in shared arrays; children of a leaf are the leaf itself, so depth steps suffice."""

    def __init__(self, start: float, trees: list[Tree]):
        sizes = [len(t.feature) for t in trees]
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32) if trees else np.zeros(0, np.int32)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if trees else np.zeros(0, kind)
        own = [np.arange(n, dtype=np.int32) + b for n, b in zip(sizes, base)]
        self.start, self.roots = start, base
        self.feature = join([np.maximum(t.feature, 0) for t in trees], np.int32)
        self.threshold = join([t.threshold for t in trees], np.float64)
        self.left = join([np.where(t.feature < 0, o, t.left + b) for t, o, b in zip(trees, own, base)], np.int32)
        self.right = join([np.where(t.feature < 0, o, t.right + b) for t, o, b in zip(trees, own, base)], np.int32)
        self.value = join([t.value for t in trees], np.float64)
        self.depth = max((depth_of(t) for t in trees), default=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def depth_of(tree: Tree, node: int = 0) -> int:
    return 0 if tree.feature[node] < 0 else 1 + max(depth_of(tree, tree.left[node]), depth_of(tree, tree.right[node]))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3) -> Forest:
    return Forest(*boost(x, y, trees, depth, rate=0.3, monotone=[-1 if f in FALLING else 0 for f in FEATURES]))


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that quality_verdicts keeps.

    Texts are judged where they are read, so no text is shuffled.
    """
    forest = fit(*labelled_sample(docs, labels, id_col, text_col, limit=limit))

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        parts = [np.zeros(0, bool)]
        for lo in range(0, len(texts), 1024):
            c, x = feature_matrix(texts.iloc[lo : lo + 1024])
            parts.append(~base_failed(c["n_words"], c["n_repeat_words"]) & (forest.score(x) >= threshold))
        return pd.Series(np.concatenate(parts))

    return docs.where(keeps(F.col(text_col).cast("string")))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """One row per document: id, the base counts, base_failed, score, kept.

    kept is false where the base limits fail, else whether the trees' score reaches ``threshold``.
    Repeated ids keep a row each.
    """
    forest = fit(*labelled_sample(docs, labels, id_col, text_col, limit=limit))
    stats = with_counts(docs, id_col, text_col)
    kind = stats.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} long" for c in BASE), "base_failed boolean", "score double", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1) if n else np.zeros((0, len(FEATURES)))
            counts = {c: b.column(c).to_numpy(zero_copy_only=False) for c in BASE}
            failed = base_failed(counts["n_words"], counts["n_repeat_words"])
            score = forest.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), *(b.column(c) for c in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                names=[id_col, *BASE, "base_failed", "score", "kept"],
            )

    return stats.select(F.col(id_col), *BASE, *(c.alias(k) for k, c in feature_columns().items())).mapInArrow(run, schema)
