"""State machines over one key's ordered rows.

A key is one sequence (a recording, a conversation), so its rows are walked in order; many keys run at once.
The state is a few values and rows are read in sorted Arrow groups: groupBy(key).applyInPandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def walked(df: DataFrame, order: list[str], walk: Callable[[pd.DataFrame], Iterator[tuple]], schema: str) -> DataFrame:
    """``walk`` turns a key's rows, in order, into output rows without the key."""
    kind = df.schema["key"].dataType.simpleString()
    names = ["key", *(c.strip().split(" ")[0] for c in schema.split(","))]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(key[0], *x) for x in walk(rows.sort_values(order, kind="stable"))]
        return pd.DataFrame(out, columns=names)

    return df.where("key is not null").groupBy("key").applyInPandas(run, f"key {kind}, {schema}")


def without_overlaps(rows: DataFrame, least: int) -> DataFrame:
    """Rows (key, id, t0, t1) whose starts move past the end of the one before; a row keeps ``least`` at least."""

    def walk(group):
        end = None
        for r in group.itertuples(index=False):
            t0 = r.t0 if end is None else max(r.t0, end)
            end = max(r.t1, t0 + least)
            yield r.id, t0, end

    return walked(rows, ["t0", "t1", "id"], walk, "id long, t0 long, t1 long")


def shots(frames: DataFrame, confirm: int, least: int) -> DataFrame:
    """Frames (key, i, label) to shots (label, i0, i1).

    A new label takes over once it has held for ``confirm`` frames and the running shot has lasted ``least``; the
    shot then starts where the label began.  Short flickers never cut.
    """

    def walk(group):
        now, since, other, began, last = None, 0, None, 0, 0
        for i, label in zip(group["i"], group["label"]):
            if now is None:
                now, since = label, i
            elif label == now:
                other = None
            else:
                if label != other:
                    other, began = label, i
                if i - began + 1 >= confirm and began - since >= least:
                    yield now, since, began
                    now, since, other = label, began, None
            last = i + 1
        if now is not None:
            yield now, since, last

    return walked(frames, ["i"], walk, "label string, i0 long, i1 long")


def viterbi(frames: DataFrame, labels: list[str], stay: float) -> DataFrame:
    """The likeliest label of every frame (key, i, one score column per label) when each change costs ``stay``.

    Of equal paths the one that stays, then the first label.
    """

    def walk(group):
        x = group[labels].to_numpy(np.float64)
        if not len(x):
            return
        best, back = x[0].copy(), np.zeros(x.shape, np.int64)
        for t in range(1, len(x)):
            top = int(np.argmax(best))
            keep = best >= best[top] - stay
            back[t] = np.where(keep, np.arange(len(labels)), top)
            best = np.where(keep, best, best[top] - stay) + x[t]
        path = [int(np.argmax(best))]
        for t in range(len(x) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        yield from zip(group["i"], (labels[p] for p in reversed(path)))

    return walked(frames, ["i"], walk, "i long, label string")


def simplified(keys: DataFrame, tolerance: float) -> DataFrame:
    """Points (key, i, v) of a piecewise-linear curve that keep it within ``tolerance``, by recursive splitting."""

    def walk(group):
        t, v = group["i"].to_numpy(np.float64), group["v"].to_numpy(np.float64)
        keep, stack = {0, len(t) - 1}, [(0, len(t) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            line = v[a] + (v[b] - v[a]) * (t[a : b + 1] - t[a]) / (t[b] - t[a])
            off = np.abs(v[a : b + 1] - line)
            k = a + int(np.argmax(off))
            if off[k - a] > tolerance:
                keep.add(k)
                stack += [(a, k), (k, b)]
        for k in sorted(keep):
            yield group["i"].iloc[k], group["v"].iloc[k]

    return walked(keys, ["i"], walk, "i long, v double")


def merged_to_count(chapters: DataFrame, most: int, least: int) -> DataFrame:
    """Chapters (key, t, title) with the closest one joined to its predecessor until gaps are ``least`` and at most ``most`` remain."""

    def walk(group):
        rows = list(zip(group["t"], group["title"]))
        while len(rows) > 1:
            gaps = [b[0] - a[0] for a, b in zip(rows, rows[1:])]
            k = int(np.argmin(gaps))
            if gaps[k] >= least and len(rows) <= most:
                break
            del rows[k + 1]
        yield from rows

    return walked(chapters, ["t", "title"], walk, "t long, title string")


def pages(words: DataFrame, width: int, lines: int) -> DataFrame:
    """Words (key, pos, token) wrapped into lines of ``width`` characters and pages of ``lines`` lines: (page, line, p0, p1, text)."""

    def walk(group):
        line, size, p0, n, last = [], 0, 0, 0, 0
        for pos, token in zip(group["pos"], group["token"]):
            if line and size + 1 + len(token) > width:
                yield n // lines, n % lines, p0, last, " ".join(line)
                line, size, n = [], 0, n + 1
            if not line:
                p0, size = pos, -1
            line.append(token)
            size += 1 + len(token)
            last = pos
        if line:
            yield n // lines, n % lines, p0, last, " ".join(line)

    return walked(words, ["pos"], walk, "page int, line int, p0 int, p1 int, text string")
