"""Caption pages: words cut into pages by time, size and sense, and each page into the best lines.

Widths are characters times a unit; a word is (key, n, text, t0, t1, brk): brk is null, ``page`` (a page starts here), ``line``
(a line does) or ``join`` (no page does).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequences import walked


@dataclass(frozen=True)
class Look:
    """Limits of a page, and what a line break costs in width units: a line longer than the next one, a comma before the
    break (a gain), a weak word (an article, a preposition) before it."""

    most_words: int = 8
    most_lines: int = 2
    most_chars: int = 24
    most_width: int = 480
    unit: int = 20
    gap: int = 700
    longest: int = 5000
    falling: int = 8
    comma: int = 40
    weak: int = 120
    weak_words: frozenset = frozenset()


@dataclass(frozen=True)
class Word:
    n: int
    text: str
    t0: int
    t1: int
    brk: str | None

    @property
    def ends(self) -> bool:
        return self.text[-1:] in (".", "?", "!")

    def holds(self, look: Look) -> bool:
        """Whether a line or page may end after the word."""
        return re.sub(r"[^\w]+", "", self.text.lower()) not in look.weak_words


def best_lines(words: list[Word], look: Look) -> tuple[int, ...] | None:
    """Where the lines of a page start (from 0), or None where no break fits.

    Fewest lines first; among those the smallest cost, in hundredths: the widest line, 0.15 of the spread of widths, and
    what the breaks cost; of equals the one with the earliest breaks.  Dynamic programming over the words: for each end and
    number of lines the partial breaks that no other one beats in widest, narrowest, last line, cost and order at once.
    """
    n = len(words)
    chars = [len(w.text) for w in words]
    forced = [i for i in range(1, n) if words[i].brk == "line"]
    # partial breaks that end before word i: (last width, widest, narrowest, cost of breaks, line starts)
    layer = {0: [(0, 0, 1 << 60, 0, ())]}
    for lines in range(1, min(look.most_lines, n) + 1):
        grown: dict[int, list] = {}
        for start, states in layer.items():
            size = -1
            for end in range(start + 1, n + 1):
                size += chars[end - 1] + 1
                width = look.unit * size
                if size > look.most_chars or width > look.most_width:
                    break
                turn = 0
                if end < n:
                    turn = 100 * ((0 if words[end - 1].holds(look) else look.weak) - (look.comma if words[end - 1].text.endswith(",") else 0))
                for last, widest, narrowest, cost, starts in states:
                    step = 100 * look.falling if starts and last > width else 0
                    grown.setdefault(end, []).append((width, max(widest, width), min(narrowest, width), cost + turn + step, (*starts, start)))
                if end in forced:
                    break
        done = grown.pop(n, [])
        if done:
            return min((100 * w + 15 * (w - s) + cost, starts) for _, w, s, cost, starts in done)[1]
        layer = {end: _unbeaten(states) for end, states in grown.items()}
    return None


def _unbeaten(states: list) -> list:
    out: list = []
    for s in sorted(states, key=lambda x: (x[3], x[1], -x[2], x[4])):
        if not any(o[0] == s[0] and o[1] <= s[1] and o[2] >= s[2] and o[3] <= s[3] and o[4] <= s[4] for o in out):
            out.append(s)
    return out


def cut_pages(words: list[Word], look: Look) -> list[list[Word]]:
    """Pages of one sequence.

    A page ends before a pause over ``gap``, after a sentence's end, where it is told to, and before a word with which it
    would last over ``longest`` or not fit.  In the last case a weak last word goes on to the next page if it fits there.
    Then a lone word that follows a page of three or more within 300 ms, in the same sentence, takes that page's last word along.
    """
    fits = lambda page: len(page) <= look.most_words and best_lines(page, look) is not None
    pages: list[list[Word]] = []
    for w in words:
        page = pages[-1] if pages else None
        if page is None:
            pages.append([w])
            continue
        told = w.brk == "page" or w.t0 - page[-1].t1 > look.gap or page[-1].ends
        full = not told and (w.t1 - page[0].t0 > look.longest or not fits([*page, w]))
        if w.brk == "join" or not (told or full):
            page.append(w)
        elif full and len(page) > 1 and not page[-1].holds(look) and page[-1].brk != "join" and fits([page[-1], w]):
            pages.append([page.pop(), w])
        else:
            pages.append([w])
    for before, after in zip(pages, pages[1:]):
        near = after[0].t0 - before[-1].t1 < 300 and not before[-1].ends
        free = after[0].brk != "page" and before[-1].brk != "page"
        if len(after) == 1 and len(before) >= 3 and look.most_words > 1 and near and free and fits([before[-1], *after]):
            after.insert(0, before.pop())
    return pages


def caption_pages(words: DataFrame, look: Look) -> DataFrame:
    """(key, page, line, w0, w1, t0, t1, text): the lines of all pages, numbered from 0.

    A page that fits no way (one long word, or words joined by hand) is cut into ``most_lines`` lines of as many words.
    One sequence is walked in order; many keys run at once.  Null texts count as empty.
    """

    def walk(rows) -> Iterator[tuple]:
        said = [Word(r.n, (r.text or "").strip(), r.t0, r.t1, r.brk) for r in rows.itertuples(index=False)]
        for p, page in enumerate(cut_pages(said, look)):
            starts = best_lines(page, look)
            if starts is None:
                starts = tuple(range(0, len(page), -(-len(page) // look.most_lines)))
            for k, (a, b) in enumerate(zip(starts, (*starts[1:], len(page)))):
                line = page[a:b]
                yield p, k, line[0].n, line[-1].n, line[0].t0, line[-1].t1, " ".join(w.text for w in line)

    return walked(words.select("key", "n", "text", "t0", "t1", F.col("brk")), ["n"], walk, "page int, line int, w0 long, w1 long, t0 long, t1 long, text string")


def page_flags(lines: DataFrame, words: DataFrame, per_second: float = 17.0, sure: float = 0.5) -> DataFrame:
    """(key, page, cps, fast, unsure): characters a second of each page, whether they are over ``per_second``, and how many
    of its words (key, n, p) have a probability under ``sure``.  A page without length counts as a millisecond."""
    pages = lines.groupBy("key", "page").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"), (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("c"), (F.max("t1") - F.min("t0")).alias("d"))
    each = pages.select("key", "page", "c", "d", F.explode(F.sequence("w0", "w1")).alias("n")).join(words.select("key", "n", "p"), ["key", "n"], "left")
    cps = F.floor(F.col("c") * 1000 / F.greatest("d", F.lit(1)) * 10 + 0.5) / 10
    counted = each.groupBy("key", "page", "c", "d").agg(F.count(F.when(F.col("p") < sure, 1)).alias("unsure"))
    return counted.select("key", "page", cps.alias("cps"), (cps > per_second).alias("fast"), "unsure")


@dataclass(frozen=True)
class Heights:
    """What a caption's height costs: faces, text and action under it (shares), distance from ``anchor`` (percent of the frame, over 30);
    a move, less after a ``pause``, and more the further it goes.  ``brief``: a stay shorter than that between like heights is no stay."""

    anchor: float = 80.0
    face: float = 8.0
    text: float = 2.0
    action: float = 4.0
    away: float = 1.5
    move: float = 1.0
    move_after_pause: float = 0.3
    far: float = 1.5
    pause: int = 1000
    brief: int = 3000
    same: float = 3.0
    step: float = 5.0


def best_heights(levels: np.ndarray, cost: np.ndarray, gaps: np.ndarray, rules: Heights) -> list[int]:
    """The cheapest sequence of levels for pages with costs (page x level), ``gaps`` before each page; of equals the lower level."""
    apart = np.abs(levels[:, None] - levels[None, :]) / 100
    total, back = cost[0].copy(), []
    for own, gap in zip(cost[1:], gaps[1:]):
        jump = rules.move_after_pause if gap >= rules.pause else rules.move
        reach = total[:, None] + np.where(apart > 1e-9, jump + rules.far * apart, 0.0)
        back.append(reach.argmin(0))
        total = reach.min(0) + own
    path = [int(total.argmin())]
    for before in reversed(back):
        path.append(int(before[path[-1]]))
    return path[::-1]


def settled(path: list[int], levels: np.ndarray, face: np.ndarray, free: list[bool], t0: list[int], t1: list[int], rules: Heights) -> list[int]:
    """``path`` without brief stays that come back to about the height before, unless a page is fixed or a face is there."""
    path, edges = list(path), [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
    for a, b, c in zip(edges[1:], edges[2:], edges[3:]):
        back = path[a - 1]
        near = abs(levels[back] - levels[path[b]]) <= rules.same
        if c > b and t1[b - 1] - t0[a] < rules.brief and near and all(free[i] and face[i, back] <= 0.02 for i in range(a, b)):
            path[a:b] = [back] * (b - a)
    return path


def caption_heights(places: DataFrame, rules: Heights = Heights()) -> DataFrame:
    """(key, n, y, why): where each page stands, for pages by possible heights (key, n, t0, t1, y, face, text, action, fixed).

    Every page of a key has the same heights y, in percent; face, text and action are shares of what it would cover there (null: none),
    ``fixed`` a height chosen by hand, one of them.  Heights are chosen together, by the least cost of all; ``why``: manual, what the
    anchor's height would have covered (face, text, action), stability, or default for the anchor's own.
    """

    def walk(rows) -> Iterator[tuple]:
        rows = rows.sort_values(["n", "y"])
        levels = np.unique(rows["y"].to_numpy(float))
        shape = (len(rows) // len(levels), len(levels))
        face, text, action = (rows[c].fillna(0.0).to_numpy(float).reshape(shape) for c in ("face", "text", "action"))
        first = rows.iloc[:: len(levels)]
        fixed, n, t0, t1 = first["fixed"].to_numpy(float), first["n"].tolist(), first["t0"].tolist(), first["t1"].tolist()
        free = np.isnan(fixed)
        cost = rules.face * face + rules.text * text + rules.action * action + rules.away * np.abs(levels - rules.anchor) / 30
        cost[~free] = np.where(np.abs(levels - fixed[~free][:, None]) < 1e-6, 0.0, 1e6)
        gaps = np.array([0, *(a - b for a, b in zip(t0[1:], t1))])
        path = settled(best_heights(levels, cost, gaps, rules), levels, face, free.tolist(), t0, t1, rules)
        home = int(np.abs(levels - rules.anchor).argmin())
        for i, k in enumerate(path):
            why = [name for name, share, most in (("face", face, 0.02), ("text", text, 0.35), ("action", action, 0.05)) if share[i, home] > most]
            moved = abs(levels[k] - rules.anchor) > 0.6 * rules.step
            yield n[i], float(levels[k]), "manual" if not free[i] else ",".join(why) or "stability" if moved else "default"

    rows = places.select("key", "n", "t0", "t1", *(F.col(c).cast("double").alias(c) for c in ("y", "face", "text", "action", "fixed")))
    return walked(rows, ["n", "y"], walk, "n long, y double, why string")
