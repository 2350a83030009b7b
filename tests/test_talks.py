"""Source splits, shot evidence and habit words against plain walks."""

import random

from tidemark.operators import talks as ta


def test_source_splits(spark):
    mics = spark.createDataFrame([("k", 0, 3), ("k", 1, 1), ("k", 2, 2), ("j", 0, 0)], "key string, speaker int, track int")
    clips = [("k", 1, "obs"), ("k", 3, "obs"), ("k", 3, "obs"), ("k", 2, "own"), ("k", 1, "dual"), ("k", 2, "dual"), ("k", 3, "dual"), ("k", 1, "x"), ("k", 2, "x"), ("j", 0, "obs")]
    media = spark.createDataFrame([("obs", 2, 2), ("dual", 1, 3), ("own", 9, 9)], "media string, streams int, channels int")
    out = ta.source_splits(mics, spark.createDataFrame(clips, "key string, track int, media string"), media)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        ("k", "obs", 1, "stream", 0), ("k", "obs", 0, "stream", 1), ("k", "dual", 1, "channel", 0), ("k", "dual", 2, "channel", 1), ("k", "dual", 0, "channel", 2),
        ("k", "x", 1, "shared", None), ("k", "x", 2, "shared", None),
    ], key=repr)


def test_shot_evidence_equals_counting_frames(spark):
    rng, shots, runs, want = random.Random(3), [], [], []
    for key in "ab":
        at, label = 0, {}
        for _ in range(60):
            size, c = rng.choice([5, 30, 80]), rng.choice(["ann", "bob", "cross", "silent", "unknown"])
            runs.append((key, c, at, at + size))
            label |= dict.fromkeys(range(at, at + size), c)
            at += size
        t = 0
        while t < at:
            end = min(at, t + rng.choice([20, 70, 200]))
            camera, why = rng.choice(["ann", "bob", "wide"]), rng.choice(["speech", "crosstalk", "silence", "reaction", "start"])
            shots.append((key, t, end, camera, why))
            seen = [label[i] for i in range(t, end)]
            talk = [c for c in seen if c not in ("silent", "unknown")]
            of = lambda c, some: int(1000 * sum(x == c for x in some) / len(some) + 0.5) if some else None
            kind = "wide" if camera == "wide" else "react" if why == "reaction" else "speaker"
            conf = of(camera, talk) if kind == "speaker" else {"crosstalk": of("cross", seen), "silence": of("silent", seen)}.get(why) if kind == "wide" else None
            want.append((key, t, end, camera, why, kind, conf))
            t = end
    df = spark.createDataFrame(shots, "key string, t0 long, t1 long, camera string, why string")
    table = spark.createDataFrame(runs, "key string, label string, i0 long, i1 long")
    assert sorted(map(tuple, ta.shot_evidence(df, table).collect()), key=repr) == sorted(want, key=repr)


def test_first_words(spark):
    words = spark.createDataFrame([("k", n, 100 * n, 100 * n + 90, f" w{n} ") for n in range(40)], "key string, n long, t0 long, t1 long, text string")
    spans = spark.createDataFrame([("k", 150, 420), ("k", 0, 4000), ("k", 9000, 9100)], "key string, t0 long, t1 long")
    out = {r.t0: r.text for r in ta.first_words(spans, words).collect()}
    assert out == {150: "w1 w2 w3 w4", 0: " ".join(f"w{n}" for n in range(10)), 9000: ""}


HABITS = ta.Habits(
    searches=(("what", "is", "it"), ("you", "know")), openers={"okay": "okay", "ok": "okay", "so": "so", "right": "right"}, closers={"right": "right", "yeah": "yeah", "like": "like"},
    opening_pairs=frozenset([("okay", "so")]), closing_pairs=frozenset([("like", "yeah")]), never_after=frozenset(["turn"]),
)


def slow_habits(words, h, on, pause=250):
    bare = lambda w: "".join(c for c in w.lower() if c.isalnum())
    t, n = [bare(w[1]) for w in words], len(words)
    ends = lambda j: j == n - 1 or words[j + 1][2] - words[j][3] > pause or words[j][4] or words[j][1].strip()[-1:] in tuple(".?!,")
    starts = lambda i: i == 0 or ends(i - 1)
    out, i = [], 0
    while i < n:
        hit = None
        for p in h.searches:
            if " ".join(p) in on and tuple(t[i : i + len(p)]) == p and i + len(p) < n and starts(i):
                hit = (len(p), "search", " ".join(p))
                break
        name = h.openers.get(t[i])
        if not hit and name in on and i + 1 < n and starts(i):
            if t[i + 1] not in h.openers:
                hit = (1, "transition", name)
            elif (name, t[i + 1]) in h.opening_pairs and t[i + 1] in on and i + 2 < n:
                hit = (2, "transition", name)
        name = h.closers.get(t[i])
        if not hit and name in on and i and t[i - 1] not in h.never_after:
            if i + 1 < n and (t[i], t[i + 1]) in h.closing_pairs:
                hit = (2, "tag", name) if t[i + 1] in on and ends(i + 1) else None
            elif ends(i):
                hit = (1, "tag", name)
        if hit:
            out.append((words[i][0], *hit))
        i += hit[0] if hit else 1
    return out


def test_habit_words_equal_a_walk(spark):
    rng, rows, want = random.Random(19), [], []
    pool = ["okay", "Ok,", "so", "right", "yeah.", "like", "you", "know", "what", "is", "it", "turn", "open", "the", "page", "--"]
    on = frozenset(["okay", "so", "right", "yeah", "like", "you know", "what is it"])
    for key, some in (("a", on), ("b", on - {"so", "you know"})):
        own, at = [], 0
        text = [w for _ in range(250) for w in rng.choice([[rng.choice(pool)], [rng.choice(pool)], ["you", "know"], ["what", "is", "it"], ["okay", "so"], ["like", "yeah"]])]
        for i, w in enumerate(text):
            at += rng.choice([20, 100, 300])
            own.append((2 * i, w, at, at + 100, rng.random() < 0.05))
            at += 100
        df = spark.createDataFrame([(key, *w) for w in own], "key string, n long, text string, t0 long, t1 long, seg boolean")
        got = sorted(tuple(r)[1:] for r in ta.habit_words(df, HABITS, some).collect())
        assert got == sorted(slow_habits(own, HABITS, some))
        assert {x[2] for x in got} == {"search", "transition", "tag"} and {x[1] for x in got} >= {1, 2, 3}
    assert ta.habit_words(df, HABITS, frozenset()).collect() == []
