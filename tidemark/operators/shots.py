"""Shot plans: cameras by speaker, reactions inside long shots, split points, angles, and zooms on activity.

Each is a walk over one key's ordered rows with a small state; keys are recordings and run at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.sequences import walked
from tidemark.operators.series import rle


@dataclass(frozen=True)
class Rules:
    """Times in frames.  A speaker takes over after ``confirm``, crosstalk and silence go to the wide camera after
    ``cross`` and ``silence`` where there is one; a shot lasts ``least``; a cut comes ``early`` before the speech."""

    confirm: int = 80
    cross: int = 120
    silence: int = 400
    least: int = 200
    early: int = 20
    wide: str | None = "wide"
    reaction: int = 150
    reaction_every: int = 400
    longest: int = 0
    aside: int = 250


#: Labels of runs that are no speaker.
LABELS = ("cross", "silent", "unknown")


def labelled_runs(owners: DataFrame) -> DataFrame:
    """(key, label, i0, i1): the runs of frames (key, i, owner)."""
    return rle(owners.withColumn("label", F.col("owner")), "label")


def speaker_shots(runs: DataFrame, scope: DataFrame, rules: Rules) -> DataFrame:
    """Runs of owners to shots (key, t0, t1, camera, why) that cover the scope (key, t0, t1), in frames.

    A run switches the camera at its first frame that is ``confirm`` into it and ``least`` into the running shot; the cut
    goes back to the run's start, ``early`` before it for speech and half a second (50 frames) after it for silence, but
    never before the running shot is ``least`` long.
    """
    kinds = {"cross": ("crosstalk", max(rules.confirm, rules.cross), 0), "silent": ("silence", rules.silence, 50)}

    def walk(rows):
        lo, hi, camera, start, why = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0]), None, int(rows["lo"].iloc[0]), "start"
        for label, a, b in zip(rows["label"], rows["i0"], rows["i1"]):
            a, b = max(a, lo), min(b, hi)
            if label == "unknown" or (label in kinds and rules.wide is None):
                continue
            reason, need, shift = kinds.get(label, ("speech", rules.confirm, -rules.early))
            target = rules.wide if label in kinds else label
            if b - a <= need or target == camera:
                continue
            if camera is None:
                camera = target
                continue
            at = max(a + need, start + rules.least)
            if at < b:
                cut = max(start + rules.least, min(a + shift, at))
                yield start, cut, camera, why
                camera, start, why = target, cut, reason
        if hi > start:
            yield start, hi, camera or rules.wide or "none", why

    rows = runs.join(scope.select("key", F.col("t0").alias("lo"), F.col("t1").alias("hi")), "key").where("i0 < hi and i1 > lo")
    return walked(rows, ["i0"], walk, "t0 long, t1 long, camera string, why string")


#: Frames of 10 ms: the shortest sound and pause that count, how early a reaction comes, how late a cut in a pause.
SOUND, PAUSE, EARLY, INTO = 15, 15, 30, 10


def cutaways(shots: DataFrame, runs: DataFrame, rules: Rules) -> DataFrame:
    """Speaker shots broken up: a listener's short sound (15 frames to ``confirm``) shows that listener for ``reaction``
    frames, ``reaction_every`` apart; with nothing for ``longest`` frames the wide camera is shown for ``aside``.

    Both last ``least`` at least, and every piece keeps ``least`` frames on the speaker; a shot with no room for that stays
    whole.  The aside begins in the longest pause of the last two fifths of ``longest``, where one of 15 frames is, the earlier of equals.
    Without a wide camera it shows the listener: who was on before, else who is next, else the speaker next by name.  Equal neighbours are one shot.
    """
    react, aside = max(rules.least, rules.reaction), max(rules.least, rules.aside)

    def pause(quiet: list, a: int, b: int) -> int | None:
        """Where the longest pause in [a, b) starts."""
        best = None
        for q0, q1 in quiet[max(0, bisect_right(quiet, (a,)) - 1) : bisect_left(quiet, (b,))]:
            size = min(q1, b) - max(q0, a)
            if size >= PAUSE and (best is None or size > best[0]):
                best = (size, max(q0, a))
        return best and best[1]

    def pieces(s0, s1, camera, why, sounds, quiet, listener):
        at, reason, k = s0, why, 0
        while True:
            first = at + max(rules.least, rules.reaction_every)
            while k < len(sounds) and sounds[k][0] - EARLY < first:
                k += 1
            show = (sounds[k][0] - EARLY, sounds[k][1], react, "reaction") if k < len(sounds) and sounds[k][0] - EARLY + react <= s1 - rules.least else None
            over = None
            if rules.longest and s1 - at > rules.longest:
                latest = min(at + rules.longest, s1 - rules.least - aside)
                if latest >= at + rules.least:
                    calm = pause(quiet, min(at + max(rules.least, 3 * rules.longest // 5), latest), latest)
                    over = (calm + INTO if calm is not None and calm + INTO <= latest else latest, rules.wide or listener, aside, "aside")
            pick = show if show and (over is None or show[0] <= over[0]) else over
            if pick is None:
                yield at, s1, camera, reason
                return
            yield at, pick[0], camera, reason
            yield pick[0], pick[0] + pick[2], pick[1], pick[3]
            at, reason = pick[0] + pick[2], "back"

    def walk(rows):
        said = [(a, b, c) for a, b, c, k in zip(rows["t0"], rows["t1"], rows["camera"], rows["run"]) if k]
        own = [(a, b, c, w) for a, b, c, w, k in zip(rows["t0"], rows["t1"], rows["camera"], rows["why"], rows["run"]) if not k]
        sounds = [(a, c) for a, b, c in said if c not in LABELS and SOUND <= b - a < rules.confirm] if rules.reaction else []
        quiet: list = []
        for a, b, c in said:
            if c in ("silent", "unknown") and quiet and quiet[-1][1] == a:
                quiet[-1] = (quiet[-1][0], b)
            elif c in ("silent", "unknown"):
                quiet.append((a, b))
        names = sorted({c for _, _, c in said if c not in LABELS})
        speakers = [x for x in own if x[2] in names]
        held, place = None, 0
        for s0, s1, camera, why in own:
            parts = [(s0, s1, camera, why)]
            if camera in names and s1 - s0 >= 2 * rules.least + min(react, aside):
                while place < len(speakers) and speakers[place][0] < s0:
                    place += 1
                other = chain(range(place - 1, -1, -1), range(place, len(speakers)))
                listener = next((speakers[j][2] for j in other if speakers[j][2] != camera), names[(names.index(camera) + 1) % len(names)])
                near = [x for x in sounds[bisect_right(sounds, (s0, chr(0x10FFFF))) : bisect_left(sounds, (s1,))] if x[1] != camera]
                parts = pieces(s0, s1, camera, why, near, quiet, listener)
            for p in parts:
                if held and held[2] == p[2]:
                    held = (held[0], p[1], *held[2:])
                else:
                    if held:
                        yield held
                    held = p
        if held:
            yield held

    labelled = runs.select("key", F.col("i0").alias("t0"), F.col("i1").alias("t1"), F.col("label").alias("camera"), F.lit("").alias("why"), F.lit(True).alias("run"))
    return walked(shots.withColumn("run", F.lit(False)).unionByName(labelled), ["t0", "run"], walk, "t0 long, t1 long, camera string, why string")


def sentence_starts(words: DataFrame, per_frame: int) -> DataFrame:
    """(key, n, t, strength): where a shot may be split, just before a word after closing punctuation (100), a segment's end
    (70), a comma (40) or a pause of 350 ms (50 and a third of its length, 100 at most); on a frame, half up."""
    line = Window.partitionBy("key").orderBy("n")
    text, gap = F.lag("text").over(line), F.col("t0") - F.lag("t1").over(line)
    mark = F.when(text.rlike("[.?!]$"), 100).when(F.lag("seg").over(line), 70).when(text.rlike("[,;:]$"), 40).otherwise(0)
    pause = F.when(gap >= 350, 50 + F.floor(F.least(gap, F.lit(1500)) / 30)).otherwise(0)
    at = F.col("t0") - F.least(F.lit(120), F.floor(F.greatest(gap, F.lit(0)) / 2))
    snapped = F.floor((2 * at + per_frame) / (2 * per_frame)) * per_frame
    rows = words.select("key", "n", snapped.cast("long").alias("t"), F.greatest(mark, pause).cast("long").alias("strength"), gap.alias("_gap"))
    return rows.where("_gap is not null and strength >= 40").drop("_gap")


def split_points(spans: DataFrame, starts: DataFrame, least: int, every: int) -> DataFrame:
    """(key, id, t): for spans (key, id, t0, t1) the points (key, t, strength) where pieces of ``least`` and about ``every``
    are cut, left to right: the strongest near the aim, or the first one after it."""

    def walk(rows):
        points = [(t, s) for t, s, k in zip(rows["t0"], rows["strength"], rows["kind"]) if k == 1]
        times = [t for t, _ in points]
        for a, b, i, k in zip(rows["t0"], rows["t1"], rows["id"], rows["kind"]):
            last = a
            while k == 0 and b - last >= 2 * least and 4 * (b - last) > 5 * every:
                lo, hi = bisect_left(times, last + least), bisect_right(times, b - least)
                near = points[lo : min(hi, bisect_right(times, last + 2 * every))] or points[lo:hi][:1]
                if not near:
                    break
                last = max(near, key=lambda x: (x[1] * every - 60 * abs(x[0] - last - every), -x[0]))[0]
                yield i, last

    own = spans.select("key", "id", "t0", "t1", F.lit(0).cast("long").alias("strength"), F.lit(0).alias("kind"))
    marks = starts.select("key", F.lit(None).cast("long").alias("id"), F.col("t").alias("t0"), F.lit(None).cast("long").alias("t1"), "strength", F.lit(1).alias("kind"))
    return walked(own.unionByName(marks), ["kind", "t0"], walk, "id long, t long")


def choose_angles(shots: DataFrame, weights: dict[str, int], scales: dict[str, int], hold: int = 0, gap: int = 500) -> DataFrame:
    """Shots (key, id, t0, t1, misfits: angles that cut the action) to (key, id, angle, held, tight).

    Never the same angle twice; the one furthest behind its share of screen time, the wider of equals.  With ``hold`` an
    angle stays until it has lasted so long, the timer starting anew after a ``gap``.  An angle that misfits is taken only
    when all do, and then the widest.
    """
    total = sum(weights.values())

    def walk(rows):
        used, time, last, since, end = dict.fromkeys(weights, 0), 0, None, 0, None
        for r in rows.itertuples(index=False):
            length = r.t1 - r.t0
            since = 0 if end is not None and r.t0 - end > gap else since
            held, tight = last is not None and since < hold, False
            if not held:
                free = [a for a in weights if a != last] or list(weights)
                fit = [a for a in free if a not in r.misfits]
                tight = not fit
                pool = fit or [min(free, key=lambda a: (scales[a], a))]
                last, since = max(pool, key=lambda a: (weights[a] * (time + length) - used[a] * total, -scales[a], a)), 0
            used[last] += length
            time, since, end = time + length, since + length, r.t1
            yield r.id, last, held, tight

    return walked(shots.select("key", "id", "t0", "t1", "misfits"), ["t0", "id"], walk, "id long, angle string, held boolean, tight boolean")


def activity_sessions(samples: DataFrame, fit: int, idle: int, weight: int, merge_gap: int, merge_fit: int, least_weight: int, least_n: int, least_span: int) -> DataFrame:
    """Samples (key, t, global, x0, y0, x1, y1, w) of a screen, boxes in thousandths, to zooms (key, t0, t1, x0, y0, x1, y1, w, n, parts).

    Samples of ``weight`` form a cluster while their joint box, with 35 % of air, fits a view of ``fit`` thousandths and no
    pause is over ``idle``; a global change ends it, and samples too wide for the view start none.  Clusters of enough weight, samples and time
    join when ``merge_gap`` apart at most, with no global change between and their joint box fitting ``merge_fit``.
    """

    def fits(b, view):
        return max(b[2] - b[0], b[3] - b[1]) * 135 <= view * 100

    def joint(a, b):
        return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))

    def clusters(rows):
        now = None  # t0, t1, box, weight, n
        for r in rows.itertuples(index=False):
            box = (r.x0, r.y0, r.x1, r.y1)
            if now and (r.whole or r.t - now[1] > idle or (r.w >= weight and not fits(joint(now[2], box), fit))):
                yield now
                now = None
            if not r.whole and r.w >= weight and fits(box, fit):
                now = (now[0], r.t, joint(now[2], box), now[3] + r.w, now[4] + 1) if now else (r.t, r.t, box, r.w, 1)
        if now:
            yield now

    def walk(rows):
        breaks = rows.loc[rows["whole"], "t"].tolist()
        held = None
        for c in clusters(rows):
            if c[3] < least_weight or c[4] < least_n or c[1] - c[0] < least_span:
                continue
            near = held and c[0] - held[1] <= merge_gap and not any(held[1] < g < c[0] for g in breaks) and fits(joint(held[2], c[2]), merge_fit)
            if held and not near:
                yield held[0], held[1], *held[2], *held[3:]
            held = (held[0], c[1], joint(held[2], c[2]), held[3] + c[3], held[4] + c[4], held[5] + 1) if near else (*c, 1)
        if held:
            yield held[0], held[1], *held[2], *held[3:]

    rows = samples.select("key", "t", F.col("global").alias("whole"), "x0", "y0", "x1", "y1", "w")
    return walked(rows, ["t"], walk, "t0 long, t1 long, x0 long, y0 long, x1 long, y1 long, w long, n long, parts long")


def quietest_corner(cells: DataFrame, columns: int, rows: int, width: int, height: int, slack: float = 0.02) -> DataFrame:
    """(key, corner): where a picture of ``width`` x ``height`` cells hides least activity of cells (key, x, y, v); of those
    within ``slack`` of the least: tr, tl, br, bl in this order."""
    right, low = F.col("x") >= columns - width, F.col("y") >= rows - height
    left, high = F.col("x") < width, F.col("y") < height
    boxes = {"tr": right & high, "tl": left & high, "br": right & low, "bl": left & low}
    sums = cells.groupBy("key").agg(*(F.sum(F.when(b, F.col("v")).otherwise(0)).alias(c) for c, b in boxes.items()))
    best = F.least(*boxes) + slack
    return sums.select("key", F.coalesce(*(F.when(F.col(c) <= best, F.lit(c)) for c in boxes)).alias("corner"))


def placement(rows: DataFrame, mode: str, full: float, picture: float) -> DataFrame:
    """Slots (key, id, busy: share, null where unread; empty: nothing on screen) with ``auto`` (full under ``full``, a picture in
    a corner under ``picture`` or where unread, else skip) and the ``place`` that the mode full, pip or auto gives."""
    auto = F.when(F.col("empty"), "full").when(F.col("busy").isNull(), "pip").when(F.col("busy") < full, "full").when(F.col("busy") < picture, "pip").otherwise("skip")
    place = F.lit(mode) if mode in ("full", "pip") else F.when(F.col("auto") == "skip", "pip").otherwise(F.col("auto"))
    return rows.withColumn("auto", auto).select("key", "id", "auto", place.alias("place"))
