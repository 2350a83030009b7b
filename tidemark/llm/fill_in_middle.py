"""Fill-in-the-middle transformation by a byte DFA.

A text's units are its runs of A-Z and a-z and every other single code point.  The automaton reads UTF-8 bytes by
class and remembers whether it stands in a run of letters and how much of a sentinel (``<P>``, ``<S>``, ``<M>``) it
has read.  Its transitions carry what they emit: the start of a unit, the start of a code point, a whole sentinel.
The first pass counts transitions, block by block, so unit, code point and sentinel counts are sums over the
transition table; the second locates the byte at which each cut's unit starts.

Any two bytes lead to the same state from wherever they are read (``AFTER_TWO`` checks it), so the states of a whole
block are one table lookup, and a block needs only the state that the block before it ended in.

A document is cut at two units, from the first 32 hex digits of sha256(``seed:doc_id``); a null id counts as an empty
string.  Texts that are null, empty or hold a sentinel stay plain, as does the stated share of the others.  Repeated
ids keep a row each and are cut alike when their texts are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Byte classes: letters that may follow "<" in a sentinel, other letters, "<", ">", continuation bytes, the rest.
MARK, LETTER, OPEN, CLOSE, CONTINUED, OTHER = range(6)
#: States: outside letters, in letters, after "<", after "<" and a letter of a sentinel (which is in letters, too).
OUTSIDE, INSIDE, OPENED, MARKED = range(4)
CLASSES, STATES = 6, 4
#: Bytes of one block of a pass.
BLOCK = 1 << 20


def _byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0] = CONTINUED
    for lo, hi in (("A", "Z"), ("a", "z")):
        table[ord(lo) : ord(hi) + 1] = LETTER
    table[[s[1] for s in (PREFIX, SUFFIX, MIDDLE)]] = MARK
    table[ord("<")], table[ord(">")] = OPEN, CLOSE
    return table


def _transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, unit starts, code point starts, sentinel ends) by state x class."""
    after = np.empty((STATES, CLASSES), np.uint8)
    unit, point, sentinel = (np.zeros((STATES, CLASSES), np.int64) for _ in range(3))
    for state in range(STATES):
        letters = state in (INSIDE, MARKED)
        for c in range(CLASSES):
            if c in (MARK, LETTER):
                after[state, c] = MARKED if state == OPENED and c == MARK else INSIDE
                unit[state, c] = not letters
            else:
                after[state, c] = OPENED if c == OPEN else OUTSIDE
                unit[state, c] = c != CONTINUED
            point[state, c] = c != CONTINUED
            sentinel[state, c] = state == MARKED and c == CLOSE
    return after, unit, point, sentinel


CLASS = _byte_classes()
AFTER, UNIT, POINT, SENTINEL = _transitions()
#: The state after two classes; it must not depend on the state before them.
AFTER_TWO = AFTER[AFTER[0]][:, :]
if any((AFTER[AFTER[s]] != AFTER_TWO).any() for s in range(STATES)):
    raise AssertionError("the automaton looks back further than two bytes")


def _blocks(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, transitions as state * CLASSES + class) of every block, the state carried from block to block."""
    raw, state = np.frombuffer(data, np.uint8), OUTSIDE
    for lo in range(0, len(raw), BLOCK):
        c = CLASS[raw[lo : lo + BLOCK]]
        states = np.empty(len(c), np.uint8)
        states[0] = state
        if len(c) > 1:
            states[1] = AFTER[state, c[0]]
            states[2:] = AFTER_TWO[c[:-2], c[1:-1]]
        state = int(AFTER[states[-1], c[-1]])
        yield lo, states * np.uint8(CLASSES) + c


def counted(data: bytes) -> np.ndarray:
    """First pass: how often each transition is taken, as a table of state x class."""
    total = np.zeros(STATES * CLASSES, np.int64)
    for _, moves in _blocks(data):
        total += np.bincount(moves, minlength=STATES * CLASSES)
    return total.reshape(STATES, CLASSES)


def located(data: bytes, units: list[int]) -> list[int]:
    """Second pass: the byte where each of the ascending unit numbers starts; a number beyond the last unit is the end."""
    out, seen, i = [], 0, 0
    emits = UNIT.ravel().astype(bool)
    for lo, moves in _blocks(data):
        if i == len(units):
            break
        starts = np.flatnonzero(emits[moves])
        while i < len(units) and units[i] < seen + len(starts):
            out.append(lo + int(starts[units[i] - seen]))
            i += 1
        seen += len(starts)
    return out + [len(data)] * (len(units) - i)


def draws(doc_id: object, seed: int = 1) -> tuple[int, int, int, int]:
    """The four 32-bit numbers of a document: two cuts, plain or not, which form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(data: bytes, h: tuple[int, int, int, int], plain_from: int = 90, spm_below: int = 20) -> tuple[str, int, int | None, int | None, bytes]:
    """(form, units, code points of prefix, of middle, output) of one text in UTF-8."""
    moves = counted(data)
    n = int((moves * UNIT).sum())
    if not data or (moves * SENTINEL).any() or h[2] % 100 >= plain_from:
        return PLAIN, n, None, None, data
    first, second = located(data, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    points = [int((counted(part) * POINT).sum()) for part in (prefix, middle)]
    if h[3] % 100 < spm_below:
        return SPM, n, *points, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return PSM, n, *points, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text of an output.  A text with sentinels stays plain, so each sentinel stands once in the other forms.

    Raises ValueError where the sentinels of the form are missing.
    """
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    at, end = output.find(second), output.find(MIDDLE)
    if form not in (PSM, SPM) or not output.startswith(first) or not 0 <= at <= end:
        raise ValueError(f"not a {form} output")
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return one + middle + two if form == PSM else two + middle + one


NAMES = ("form", "n", "prefix_chars", "middle_chars", "output")


def transformed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20, keep_text: bool = True
) -> DataFrame:
    """``docs`` with form, n (units), prefix_chars, middle_chars (null when plain) and output after its columns.

    Columns of ``docs`` named like the new ones give way to them.  Without ``keep_text`` only id and new columns return.
    """
    own = [c for c in docs.columns if c not in NAMES] if keep_text else [id_col]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # outputs are as long as the texts
                part = b.slice(lo, 256)
                made = [transform((t.as_py() or "").encode(), draws(i.as_py(), seed), plain_from, spm_below) for i, t in zip(part.column(0), part.column(1))]
                form, n, prefix, middle, output = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[2:], pa.array(form, pa.string()), pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                        pa.array([o.decode() for o in output], pa.string()),
                    ],
                    names=[*own, *NAMES],
                )

    rows = docs.select(F.col(id_col).cast("string").alias("_i"), F.col(text_col).cast("string").alias("_t"), *(F.col(c) for c in own))
    return rows.mapInArrow(run, kinds + "form string, n long, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``rows`` with ``restored``, the text rebuilt from form and output; null where the output is null."""

    @F.pandas_udf("string")
    def rebuild(forms, outputs):
        return outputs.combine(forms, lambda o, f: None if o is None else restore(o.encode(), f).decode())

    return rows.withColumn("restored", rebuild(F.col(form_col), F.col(output_col)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, and sha256 of the output and of the text rebuilt from it."""
    rows = restored(transformed(docs, id_col, text_col, keep_text=False))
    return rows.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
