"""Document statistics, one pass over each whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words

#: The symbols counted in n_symbols, white space, and further classes of characters.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
STOPS = b".,;:?"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_digits", "n_stops", "n_bangs", "n_pipes", "n_distinct", "n_same_next",
)

#: Features of a model: every one a ratio of counts or a logarithm, so that they do not depend on the corpus.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "line_words", "upper_share",
    "digit_share", "stop_share", "bang_share", "pipe_share", "distinct_share", "same_next_share",
)


def repeat_words(tokens: list) -> int:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included."""
    if len(tokens) < 4:
        return 0
    windows = list(zip(tokens, tokens[1:], tokens[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for a text; null and empty texts are all zeros."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    tokens = raw.split()
    size = len(raw)
    has = lambda chars: size - len(raw.translate(None, chars))
    return (
        len(tokens), len(text) - has(SPACE), has(SYMBOLS), dup_lines(raw), repeat_words(tokens), raw.count(b"\n") + 1,
        has(UPPER), has(DIGITS), has(STOPS), raw.count(b"!"), raw.count(b"|"), len(set(tokens)),
        sum(map(bytes.__eq__, tokens, tokens[1:])),
    )


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the counts of each whole text; other columns are left behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t.as_py()) for t in b.column(1)]
            columns = list(zip(*rows)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} long" for c in COUNTS)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _ratios(c: dict, log1p: Callable, some: Callable) -> dict:
    """FEATURES from COUNTS, as Spark expressions or as arrays; texts without words give defined values."""
    n, chars, lines = some(c["n_words"]), some(c["word_chars"]), some(c["n_lines"])
    return {
        "log_words": log1p(c["n_words"]),
        "mean_word": c["word_chars"] / n,
        "symbol_share": c["n_symbols"] / chars,
        "dup_line_share": c["n_dup_lines"] / lines,
        "repeat_share": c["n_repeat_words"] / n,
        "line_words": c["n_words"] / lines,
        "upper_share": c["n_upper"] / chars,
        "digit_share": c["n_digits"] / chars,
        "stop_share": c["n_stops"] / n,
        "bang_share": c["n_bangs"] / n,
        "pipe_share": c["n_pipes"] / n,
        "distinct_share": c["n_distinct"] / n,
        "same_next_share": c["n_same_next"] / n,
    }


def feature_columns() -> dict[str, Column]:
    """FEATURES as Spark expressions over COUNTS."""
    return _ratios({c: F.col(c) for c in COUNTS}, F.log1p, lambda x: F.greatest(x, F.lit(1)))


def feature_matrix(texts: Iterable[str | None]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of texts by name, and their FEATURES as the columns of a matrix."""
    rows = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
    c = {name: rows[:, j] for j, name in enumerate(COUNTS)}
    found = _ratios(c, np.log1p, lambda x: np.maximum(x, 1))
    return c, np.stack([found[f] for f in FEATURES], axis=1)
