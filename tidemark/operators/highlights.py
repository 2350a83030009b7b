"""Highlights from units of speech (key, n, t0, t1, text, grp, filler): windows, clips that fit, cue scores, ranking.

Units are numbered from 0 in a key; grp is the number of the scope range they lie in.  A clip never leaves its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import OTHER
from tidemark.operators.intervals import overlapping
from tidemark.operators.sequences import walked


def said(text: Column) -> Column:
    """The lower-cased words of a text, hyphens inside kept."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, OTHER.replace("_]", r"_\-]"), ""), "^-+|-+$", ""))
    return F.filter(words, lambda w: w != "")


def units(sentences: DataFrame, scope: DataFrame, bad: str, openers: tuple[str, ...]) -> DataFrame:
    """Sentences (key, n, t0, t1, text) whose middle lies in a scope range (key, id, t0, t1), numbered anew: with grp
    (changes with the range and where a sentence is left out), range, filler (up to three words, all openers) and gap
    (since the unit before, for the first since its range's start).  Sentences that match ``bad`` are left out."""
    middle = F.floor((F.col("t0") + F.col("t1")) / 2).cast("long")
    inner = overlapping(sentences.select("key", "n", middle.alias("t0"), (middle + 1).alias("t1")), scope, 60_000, "a").groupBy("key", "n").agg(F.min(F.struct("b_t0", "b_t1", "b_id")).alias("s"))
    rows = sentences.join(inner, ["key", "n"], "left").withColumn("_ok", F.col("s").isNotNull() & ~F.col("text").rlike(bad))
    line = Window.partitionBy("key").orderBy("n")
    rows = rows.withColumn("_skipped", F.coalesce(F.lag("_ok").over(line), F.lit(True))).withColumn("_holes", F.sum((~F.col("_skipped")).cast("int")).over(line)).where("_ok")
    kept = Window.partitionBy("key").orderBy("n")
    new = F.coalesce((F.lag("_holes").over(kept) != F.col("_holes")) | (F.lag("s.b_id").over(kept) != F.col("s.b_id")), F.lit(True))
    words = said(F.col("text"))
    filler = (F.size(words) > 0) & (F.size(words) <= 3) & F.forall(words, lambda w: w.isin(*openers))
    rows = rows.withColumns({"_new": new.cast("int"), "gap": F.col("t0") - F.coalesce(F.lag("t1").over(kept), "s.b_t0"), "filler": filler, "i": F.row_number().over(kept) - 1})
    return rows.select("key", F.col("i").cast("long").alias("n"), "t0", "t1", "text", (F.sum("_new").over(kept) - 1).alias("grp"), F.col("s.b_id").alias("range"), "filler", "gap")


def windows(units: DataFrame, size: int, step: int) -> DataFrame:
    """(key, grp, w, a, b): the first and last unit that start in each window of ``size``, every ``step`` from a group's
    start, until one reaches the group's end; empty windows are left out."""
    group = units.groupBy("key", "grp").agg(F.min("t0").alias("g0"), F.max("t1").alias("g1"))
    last = F.greatest(F.ceil((F.col("g1") - size - F.col("g0")) / step), F.lit(0))
    rows = units.join(group, ["key", "grp"]).withColumn("_o", F.col("t0") - F.col("g0"))
    lowest = F.greatest(F.floor((F.col("_o") - size) / step) + 1, F.lit(0))
    w = rows.withColumn("w", F.explode(F.sequence(lowest, F.floor(F.col("_o") / step)))).where(F.col("w") <= last)
    return w.groupBy("key", "grp", "w").agg(F.min("n").alias("a"), F.max("n").alias("b"))


def fitted(units: DataFrame, starts: DataFrame, least: int, most: int, target: int, rest: int, mid: int) -> DataFrame:
    """For starts (key, id, a, b) the span of units (key, id, a, b) that lasts ``least`` to ``most``.

    It shrinks from the end to ``most``, grows to ``least`` (a unit behind if it fits, else one before that is no filler),
    then to ``target`` while the pause behind is under ``rest``, and ends at a pause of ``mid`` if it can.  Spans under
    four fifths of ``least`` or over ``most`` go.  A span stays in the group of its start.
    """

    def walk(rows):
        one = {r.n: r for r in rows.itertuples(index=False) if r.asked < 0}
        for q in rows.itertuples(index=False):
            if q.asked < 0 or q.n not in one:
                continue
            grp = one[q.n].grp
            inside = lambda x: x in one and one[x].grp == grp
            time = lambda x, y: one[y].t1 - one[x].t0
            behind = lambda y: one[y + 1].t0 - one[y].t1 if inside(y + 1) else None
            longer = lambda x, y: inside(y + 1) and time(x, y + 1) <= most
            a, b = q.n, q.n
            while b < q.last and inside(b + 1):
                b += 1
            while b > a and time(a, b) > most:
                b -= 1
            while time(a, b) < least:
                if longer(a, b):
                    b += 1
                elif inside(a - 1) and time(a - 1, b) <= most and not one[a - 1].filler:
                    a -= 1
                else:
                    break
            while longer(a, b) and time(a, b) < target and behind(b) < rest:
                b += 1
            while longer(a, b) and behind(b) < mid:
                b += 1
            if 5 * time(a, b) >= 4 * least and time(a, b) <= most:
                yield q.asked, a, b

    own = units.select("key", F.lit(-1).cast("long").alias("asked"), "n", "n", "t0", "t1", "grp", "filler").toDF("key", "asked", "n", "last", "t0", "t1", "grp", "filler")
    asked = starts.select("key", F.col("id").alias("asked"), F.col("a").alias("n"), F.col("b").alias("last"), *(F.lit(None).cast("long").alias(c) for c in ("t0", "t1", "grp")), F.lit(False).alias("filler"))
    return walked(own.unionByName(asked.select(own.columns)), ["n", "asked"], walk, "id long, a long, b long")


def bounds(spans: DataFrame, units: DataFrame, scope: DataFrame, before: int, after: int, end: int) -> DataFrame:
    """(key, id, t0, t1) of spans of units: the start moves into half the pause before, ``before`` at most, the end into
    half of the one behind, ``after`` at most, both inside the range; behind a group's last unit ``end`` is free."""
    line = Window.partitionBy("key", "grp").orderBy("n")
    u = units.select("key", "n", "grp", "range", "t0", "t1", F.lag("t1").over(line).alias("p1"), F.lead("t0").over(line).alias("q0"))
    ranges = scope.select("key", F.col("id").alias("range"), F.col("t0").alias("r0"), F.col("t1").alias("r1"))
    a = u.join(ranges, ["key", "range"]).select("key", F.col("n").alias("a"), "t0", "p1", "r0", "r1")
    b = u.select("key", F.col("n").alias("b"), "t1", "q0")
    rows = spans.join(a, ["key", "a"]).join(b, ["key", "b"])
    half = lambda c: F.floor(F.greatest(c, F.lit(0)) / 2).cast("long")
    start = F.greatest(F.col("r0"), F.col("t0") - F.least(F.lit(before), half(F.col("t0") - F.coalesce("p1", "r0"))))
    stop = F.least(F.col("r1"), F.col("t1") + F.least(F.lit(after), half(F.coalesce("q0", F.least(F.col("r1"), F.col("t1") + end)) - F.col("t1"))))
    return rows.select("key", "id", start.alias("t0"), stop.alias("t1"))


def cue_hits(text: Column, cues: tuple[str, ...]) -> Column:
    """Cue words and whole numbers in a text, and its question marks."""
    hits = F.filter(said(text), lambda w: w.isin(*cues) | w.rlike(r"^[0-9]+$"))
    return F.size(hits) + F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("?"), F.lit("")))


def hook_strength(text: Column, cues: tuple[str, ...], questions: tuple[str, ...]) -> Column:
    """0 to 100: 30 for a question, 22 for each cue; 0 without words."""
    words = said(text)
    asks = F.coalesce(F.get(words, F.lit(0)).isin(*questions), F.lit(False)) | F.contains(text, F.lit("?"))
    return F.when(F.size(words) == 0, 0).otherwise(F.least(F.when(asks, 30).otherwise(0) + 22 * cue_hits(text, cues), F.lit(100)))


def rule_score(hook: Column, value: Column, energy: Column, density: Column, weight: float, topic: Column | None = None) -> Column:
    """20 + 0.6 of the weighted sum (0.35 hook, 0.25 value, ``weight`` energy, what is left of 0.4 density), plus 15 times
    the topic's share, or less 12 where it is 0; rounded half even, 1 to 85."""
    raw = 20 + 0.6 * (0.35 * hook + 0.25 * value + weight * energy + (0.4 - weight) * density)
    raw = raw if topic is None else raw + F.coalesce(15 * topic - F.when(topic == 0, 12).otherwise(0), F.lit(0))
    return F.least(F.greatest(F.bround(F.round(raw, 9)), F.lit(1)), F.lit(85)).cast("int")


def composite_score(hook: Column, flow: Column, value: Column, trend: Column, energy: Column, weight: float = 0.1) -> Column:
    """0.35 hook, 0.2 flow, 0.25 value and 0.1 trend over 0.9, then ``weight`` of energy; rounded half even."""
    base = (0.35 * hook + 0.2 * flow + 0.25 * value + 0.1 * trend) / 0.9
    return F.bround(F.round((1 - weight) * base + weight * energy, 9)).cast("int")


def finished(clips: DataFrame, count: int) -> DataFrame:
    """(key, id, score, place, on, colour): judged clips get 8 for their topic's share and lose 10 for ungrounded numbers,
    1 to 99; by score, then start; the first ``count`` are on.  Green from 80, yellow from 60, else orange."""
    bonus = F.when(F.col("judged"), F.bround(8 * F.coalesce("topic", F.lit(0.0))) - F.when(F.col("ungrounded"), 10).otherwise(0)).otherwise(0)
    score = F.least(F.greatest(F.col("score") + bonus, F.lit(1)), F.lit(99)).cast("int")
    rows = clips.withColumn("score", score)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "t0", "id"))
    colour = F.when(F.col("score") >= 80, "green").when(F.col("score") >= 60, "yellow").otherwise("orange")
    return rows.select("key", "id", "score", place.alias("place"), (place <= count).alias("on"), colour.alias("colour"))


def clip_count(span: Column, target: float) -> Column:
    """One clip for 210 seconds, or up to three that fit with a fifth to spare, 1 to 20."""
    return F.least(F.greatest(F.bround(span / 210), F.least(F.lit(3), F.floor(span / (target * 1.2))), F.lit(1)), F.lit(20)).cast("int")
