"""Tracks, smoothed paths and shots between page changes against plain walks."""

import math
import random
from difflib import SequenceMatcher

import numpy as np

from tidemark.operators import motion as mo
from tidemark.operators import sounds as so


def slow_tracks(rows, gap=1000, least=0.1, jump=0.25):
    tracks, out = [], []
    for t in sorted({r[0] for r in rows}):
        now = sorted(r for r in rows if r[0] == t)
        pairs = []
        for _, f, x, y, w, h in now:
            for n, (seen, (a, b, c, d)) in enumerate(tracks):
                if t - seen > gap:
                    continue
                shared = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
                iou = shared / (w * h + c * d - shared + 1e-9)
                away = math.hypot(x + w / 2 - a - c / 2, y + h / 2 - b - d / 2)
                if iou >= least or away <= jump:
                    pairs.append((-(iou + jump - away), f, n))
        own = {}
        for _, f, n in sorted(pairs):
            if f not in own and n not in own.values():
                own[f] = n
        for _, f, *box in now:
            n = own.get(f, len(tracks))
            if n == len(tracks):
                tracks.append(None)
            tracks[n] = (t, box)
            out.append((t, f, n))
    return out


def test_box_tracks(spark):
    rng, rows, want = random.Random(3), [], []
    for key in "ab":
        own, paths = [], [[rng.random(), rng.random()] for _ in range(4)]
        for t in range(0, 20_000, 400):
            boxes = []
            for p in paths:
                p[0], p[1] = p[0] + rng.uniform(-0.06, 0.06), p[1] + rng.uniform(-0.06, 0.06)
                if rng.random() < 0.75:
                    boxes.append((p[0], p[1], 0.1 + rng.random() * 0.05, 0.12))
            rng.shuffle(boxes)
            own += [(t, f, *b) for f, b in enumerate(boxes)]
        rows += [(key, *r) for r in own]
        want += [(key, *r) for r in slow_tracks(own, jump=0.1)]
    rows.append(("a", 99_000, 0, None, 0.1, 0.1, 0.1))
    df = spark.createDataFrame(rows, "key string, t long, f long, x double, y double, w double, h double")
    assert sorted(tuple(r) for r in mo.box_tracks(df, jump=0.1).collect()) == sorted(want) and len({w[3] for w in want}) > 5


def dense_path(t, x, q, r, p0=0.01):
    """The mean of all positions given the seen ones, by one big Gaussian."""
    n = len(t)
    known = ~np.isnan(x)
    mean = np.tile([x[known][0] if known.any() else 0.5, 0.0], n)
    cov = np.zeros((2 * n, 2 * n))
    p = np.eye(2) * p0
    for i in range(n):
        if i:
            d = t[i] - t[i - 1]
            f = np.array([[1, d], [0, 1]])
            p = f @ p @ f.T + q * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]])
        cov[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = p
        g = p
        for j in range(i + 1, n):  # the covariance with a later time moves along
            g = np.array([[1, t[j] - t[j - 1]], [0, 1]]) @ g
            cov[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = g
            cov[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = g.T
    at = 2 * np.flatnonzero(known)
    gain = cov[:, at] @ np.linalg.inv(cov[np.ix_(at, at)] + r * np.eye(len(at)))
    return (mean + gain @ (x[known] - mean[at]))[::2]


def test_smooth_path_is_the_mean_of_one_gaussian():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 40):
        t = np.cumsum(rng.uniform(0.1, 0.7, n))
        x = 0.5 + 0.2 * np.sin(t) + rng.normal(0, 0.02, n)
        x[rng.random(n) < 0.3] = np.nan
        assert np.allclose(mo.smooth_path(t, x), dense_path(t, x, 0.02, 0.0004), atol=1e-6)
    assert np.allclose(mo.smooth_path(np.array([0.0, 1.0]), np.array([np.nan, np.nan])), 0.5)


def slow_moving(t, x, on=0.03, off=0.015, least=1.0, travel=0.05):
    speed, flags, state = np.abs(np.gradient(x, t)), [], False
    for v in speed:
        state = bool(v > on or (state and v > off))
        flags.append(state)
    i = 0
    while i < len(t):
        j = i
        while j < len(t) and flags[j]:
            j += 1
        if j > i and (t[j - 1] - t[i] < least or abs(x[j - 1] - x[i]) < travel):
            flags[i:j] = [False] * (j - i)
        i = max(j, i + 1)
    return flags


def test_paths_of_many_keys(spark):
    rng, rows = random.Random(11), []
    for key in "xyz":
        at, place = 0, 0.5
        for i in range(120):
            at += rng.choice([200, 200, 250, 600])
            place += rng.choice([0, 0, 0.01, 0.02]) * (1 if i % 60 < 30 else -1)
            rows.append((key, at, None if rng.random() < 0.2 else place))
    rows.append(("x", rows[0][1], 5.0))  # a second point of one time, the larger one
    out = mo.smoothed_paths(spark.createDataFrame(rows, "key string, t long, x double")).collect()
    seen = set()
    for key in "xyz":
        got = sorted((r.t, r.x, r.moving) for r in out if r.key == key)
        own = dict((t, x) for k, t, x in rows[:-1] if k == key)
        if key == "x" and own[rows[0][1]] is None:
            own[rows[0][1]] = 5.0
        t = np.array(sorted(own)) / 1000
        path = dense_path(t, np.array([np.nan if own[k] is None else own[k] for k in sorted(own)]), 0.02, 0.0004)
        assert np.allclose([g[1] for g in got], path, atol=1e-6)
        assert [g[2] for g in got] == slow_moving(t, np.array([g[1] for g in got]))
        seen |= {g[2] for g in got}
    assert seen == {True, False}


def slow_shots(rows, step, around, least):
    """Rows (t, page, m, mx, my) of one key."""
    a, b = rows[0][0] - step / 2, rows[-1][0] + step / 2
    kept = []
    for i, r in enumerate(rows):
        if r[1] and not (i and rows[i - 1][1]) and (not kept or r[0] - kept[-1] >= 1000):
            kept.append(r[0])
    cuts = [t - step / 2 for t in kept if a + 300 < t - step / 2 < b - 300]
    out = []
    for k, (s0, s1) in enumerate(zip([a, *cuts], [*cuts, b])):
        own = [r for r in rows if s0 <= r[0] < s1]
        places = []
        for i in range(len(own)):
            near = [r for r in own[max(0, i - around) : i + around + 1] if not r[1]]
            m = sum(r[2] for r in near)
            places.append((sum(r[3] for r in near) / m, sum(r[4] for r in near) / m) if m >= least else (None, None))
        trim = [(s1 < b and r[0] > s1 - 800) or (k > 0 and r[0] < s0 + 300) for r in own]
        if any(p[0] is not None and not c for p, c in zip(places, trim)):
            places = [(None, None) if c else p for p, c in zip(places, trim)]
        out += [(r[0], k, *p) for r, p in zip(own, places)]
    return out


def test_page_shots(spark):
    rng, rows, want = random.Random(2), [], []
    for key in "ab":
        own = []
        for i in range(150):
            m = rng.choice([0, 0, 3, 8])
            own.append((100 + 200 * i, rng.random() < 0.07, m, m * rng.randrange(50), m * rng.randrange(30)))
        rows += [(key, *r) for r in own]
        want += [(key, *r) for r in slow_shots(own, 200, 3, 12)]
    df = spark.createDataFrame(rows, "key string, t long, page boolean, m long, mx long, my long")
    got = sorted(tuple(r) for r in mo.page_shots(df, 200, 3, 12).collect())
    assert got == sorted(want) and max(x[2] for x in want) > 3 and any(x[3] is None for x in want)


def test_animated_cells_equal_a_step_by_step_loop(spark):
    rng, rows, want = random.Random(5), [], {}
    for key, alpha in (("a", 0.1),):
        for cell in range(4):
            level, at = 0.0, {k for k in range(1500) if rng.random() < (0.05, 0.5, 0.95, 0.6 if k % 700 < 300 else 0.0)[cell]}
            for k in range(1500):
                level = level * (1 - alpha) + (alpha if k in at else 0.0)
                if k in at:
                    rows.append((key, cell, k))
                    want[key, cell, k] = level
    df = spark.createDataFrame([*rows, rows[0], (None, 1, 2)], "key string, cell int, k long")
    got = {(r.key, r.cell, r.k): (r.level, r.masked) for r in mo.animated_cells(df, 0.1).collect()}
    assert got.keys() == want.keys() and all(abs(got[x][0] - want[x]) < 1e-9 and got[x][1] == (want[x] > 0.5) for x in want)
    assert {m for _, m in got.values()} == {True, False}


# ---- sounds --------------------------------------------------------------------------------------


def test_claims_equal_a_walk_backwards(spark):
    rng, words, islands, want = random.Random(1), [], [], []
    for key in "ab":
        at, own = 0, []
        for i in range(80):
            a = at + rng.choice([30, 100, 130, 300])
            at = a + rng.choice([60, 150, 400])
            own.append((i, a, at, rng.random() < 0.4))
        islands += [(key, *x) for x in own]
        for n in range(60):
            a = rng.randrange(0, at)
            b, need = a + rng.choice([80, 400, 1500]), rng.choice([100, 300, 600])
            words.append((key, n, a, b, need))
            got, mine = 0, []
            for i, s, e, held in reversed([x for x in own if x[2] > a + 20 and x[1] < b - 20]):
                if mine and (got >= 0.6 * need or held) and own[mine[-1]][1] - e > 120:
                    break
                mine.append(i)
                got += min(e, b) - max(s, a)
            want += [(key, n, i) for i in mine]
    df = spark.createDataFrame(words, "key string, id long, t0 long, t1 long, need long")
    table = spark.createDataFrame(islands, "key string, id long, t0 long, t1 long, held boolean")
    assert sorted(tuple(r) for r in so.claimed(df, table).collect()) == sorted(want) and len(want) > 100


def test_detections_merge_by_rank(spark):
    rng, rows, want = random.Random(5), [], []
    for key in "ab":
        own = []
        for i in range(120):
            a = rng.randrange(0, 6000)
            sub = rng.choice(["lexicon", "listener", "orphan", "drawl"])
            own.append((i, a, a + rng.choice([20, 60, 150]), sub, {"lexicon": 0, "listener": 0, "orphan": 1, "drawl": 4}[sub], rng.randrange(10, 97)))
        rows += [(key, *x) for x in own]
        kept = []
        for i, a, b, sub, order, conf in sorted(own, key=lambda x: (x[4], -x[5], x[0])):
            same = [k for k in kept if a < k[2] and k[1] < b]
            if not same:
                kept.append([i, a, b, sub, conf, [sub]])
            elif sub not in same[0][5]:
                same[0][5].append(sub)
                if conf >= 30:
                    same[0][4] = min(97, max(same[0][4], conf) + 5)
        want += [(key, *k[:5], ",".join(k[5])) for k in kept]
    df = spark.createDataFrame(rows, "key string, id long, t0 long, t1 long, sub string, rank int, conf int")
    assert sorted(tuple(r) for r in so.merged_by_rank(df, 100).collect()) == sorted(want) and any("," in w[6] for w in want)


def test_words_heard_again_equal_all_pairs(spark):
    rng = random.Random(6)
    pool = ["menu", "menus", "many", "open", "opened", "it", "--", "éa"]
    make = lambda n: [(rng.choice("ab"), i, rng.choice([*pool, None]), t := rng.randrange(0, 60_000), t + rng.choice([100, 900])) for i in range(n)]
    new, rows = make(60), make(120)
    kind = "key string, id long, text string, t0 long, t1 long"
    bare = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    near = lambda r, x: x[0] == r[0] and x[4] >= r[3] - 1000 and x[3] <= r[4] + 1000
    want = {(r[0], r[1]): not bare(r[2]) or any(near(r, x) and SequenceMatcher(None, bare(r[2]), bare(x[2])).ratio() >= 0.75 for x in rows) for r in new}
    out = so.heard_again(spark.createDataFrame(new, kind), spark.createDataFrame(rows, kind)).collect()
    assert {(r.key, r.id): r.again for r in out} == want and len(out) == len(new) and len(set(want.values())) == 2


def test_cursor_rests_equal_a_walk(spark):
    rng, rows, want = random.Random(8), [], []
    for key in "ab":
        last = None
        for i in range(300):
            t, page = 200 * i, rng.random() < 0.03
            moved = rng.random() < 0.15
            row = (key, t, page, rng.random() if moved else None, 0.5 if moved else None, rng.choice([None, 0.01, 0.2]), rng.choice([None, False, False, True]))
            rows.append(row)
            if page:
                last = None
            elif moved:
                last = (t, row[3], row[4]) if (row[5] is None or row[5] >= 0.04) and not row[6] else None
            elif last and 600 <= t - last[0] <= 2000:
                want.append((key, t, *last[1:]))
    df = spark.createDataFrame(rows, "key string, t long, page boolean, x double, y double, detail double, zone boolean")
    assert sorted(tuple(r) for r in so.cursor_rests(df).collect()) == sorted(want) and len(want) > 50
