"""Chapters from sentences (key, n, t0, t1, text): boundaries by pause and change of words, checks, merging, titles.

Sentences are numbered from 0 without gaps.  Texts are compared as bags of content tokens, which callers give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.sequences import walked


def wanted(span: Column, mode: str | int = "normal", each: int = 240) -> Column:
    """How many chapters a span of seconds gets: one for ``each``, 3 to 15; fewer: six tenths, 3 at least; more: 1.6
    times, 25 at most.  Halves round to the even number.  A number as mode is taken as it is, 1 to 50."""
    if str(mode).strip().isdigit():
        return F.when(span.isNotNull(), F.lit(max(1, min(50, int(mode)))))
    base = F.greatest(F.least(F.bround(span / each), F.lit(15)), F.lit(3))
    return {"normal": base, "less": F.greatest(F.bround(base * 0.6), F.lit(3)), "more": F.least(F.bround(base * 1.6), F.lit(25))}[mode].cast("int")


def real_sentences(rows: DataFrame, stock: tuple[str, ...]) -> DataFrame:
    """Sentences (text) that are speech: no stock phrase in them, no short part of one, no word over half of four or more."""
    plain = F.filter(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", "")), lambda w: w != "")
    bare = F.array_join(plain, " ")
    has = F.exists(F.array(*map(F.lit, stock)), lambda p: F.contains(F.lower("text"), p))
    piece = (F.length(bare) >= 6) & (F.size(plain) <= 4) & F.exists(F.array(*map(F.lit, stock)), lambda p: F.contains(p, bare))
    top = F.array_max(F.transform(F.array_distinct(plain), lambda w: F.size(F.filter(plain, lambda x: x == w))))
    return rows.where(~has & ~piece & ~((F.size(plain) >= 4) & (2 * top > F.size(plain))))


def gaps(sentences: DataFrame, scope: DataFrame) -> DataFrame:
    """``sentences`` with the pause before each: since the end of the one before, the first since the scope's t0; never below 0."""
    before = F.lag("t1").over(Window.partitionBy("key").orderBy("n"))
    rows = sentences.join(scope.select("key", F.col("t0").alias("_lo")), "key")
    return rows.withColumn("gap", F.greatest(F.col("t0") - F.coalesce(before, "_lo"), F.lit(0))).drop("_lo")


def blocks(sentences: DataFrame, target: int, pause: int) -> DataFrame:
    """Sentences with gaps to blocks (key, s0, s1, t0, t1): one that would last over ``target`` ends before a pause over
    ``pause``, and in any case before it lasts over half as much again."""

    def walk(rows):
        first = last = None
        for r in rows.itertuples(index=False):
            if first is not None and r.t1 - first.t0 > target and (r.gap > pause or 2 * (r.t1 - first.t0) > 3 * target):
                yield first.n, last.n, first.t0, last.t1
                first = None
            first, last = first or r, r
        if first is not None:
            yield first.n, last.n, first.t0, last.t1

    return walked(sentences.select("key", "n", "t0", "t1", "gap"), ["n"], walk, "s0 long, s1 long, t0 long, t1 long")


def parts(blocks: DataFrame, each: int) -> DataFrame:
    """Blocks with ``part``: as many parts as the key's span holds ``each`` (rounded half even, one at least, no more than
    blocks), of equal numbers of blocks but for the last."""
    order, all_ = Window.partitionBy("key").orderBy("t0"), Window.partitionBy("key")
    size, place = F.count(F.lit(1)).over(all_), F.row_number().over(order) - 1
    span = F.max("t1").over(all_) - F.min("t0").over(all_)
    rows = blocks.select("*", size.alias("_n"), place.alias("_p"), span.alias("_span"))
    count = F.greatest(F.least(F.bround(F.col("_span") / each), F.col("_n")), F.lit(1))
    return rows.withColumn("part", F.floor(F.col("_p") / F.ceil(F.col("_n") / count)).cast("long")).drop("_n", "_p", "_span")


def boundary_scores(sentences: DataFrame, bags: DataFrame, window: int, reach: int, cap: int, cues: Column) -> DataFrame:
    """(key, n, score) of every sentence but the first, in thousandths: 450 for the pause before (up to ``cap``), 350 for
    the change of words (1 - cosine) between the sentences of the ``window`` before and after it, ``reach`` of them at
    most, and ``cues``, a column over the sentence.

    ``bags`` is (key, n, token, tf).  Each sentence's tokens are sent to the boundaries they count for, at most
    2 * ``reach`` of them, so nothing is joined but equal keys and numbers.
    """
    starts = sentences.select("key", "n", "t0")
    near = starts.withColumn("m", F.explode(F.sequence(F.greatest(F.col("n") - reach + 1, F.lit(1).cast("long")), F.col("n") + reach)))
    other = starts.select("key", F.col("n").alias("m"), F.col("t0").alias("at"))
    pairs = near.join(other, ["key", "m"])
    after = (F.col("n") >= F.col("m")) & (F.col("n") < F.col("m") + reach) & (F.col("t0") < F.col("at") + window)
    before = (F.col("n") < F.col("m")) & (F.col("n") >= F.col("m") - reach) & (F.col("t0") >= F.col("at") - window)
    sides = pairs.where(after | before).select("key", "m", "n", after.alias("after"))
    counts = sides.join(bags, ["key", "n"]).groupBy("key", "m", "token").agg(F.sum(F.when(F.col("after"), F.col("tf")).otherwise(0)).alias("a"), F.sum(F.when(F.col("after"), 0).otherwise(F.col("tf"))).alias("b"))
    dots = counts.groupBy("key", "m").agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("qa"), F.sum(F.col("b") * F.col("b")).alias("qb"))
    rows = sentences.where("n >= 1").join(dots.withColumnRenamed("m", "n"), ["key", "n"], "left")
    cosine = F.when((F.col("qa") > 0) & (F.col("qb") > 0), F.col("dot") / F.sqrt(F.col("qa").cast("double") * F.col("qb"))).otherwise(0.0)
    score = 450 * F.least("gap", F.lit(cap)) / cap + 350 * (1 - cosine) + cues
    return rows.select("key", "n", F.floor(score + 1e-6).cast("long").alias("score"))


def validated(picks: DataFrame, scope: DataFrame, lead: int, least: int) -> DataFrame:
    """Picks (key, n, t0, gap) to chapters (key, n, t): the first at the scope's t0, later ones ``lead`` or half the pause
    before their sentence, ``least`` after the last kept one, and none in the last ``least`` but the first."""

    def walk(rows):
        kept = []
        for r in rows.itertuples(index=False):
            t = max(r.lo, r.t0 - min(lead, r.gap // 2)) if kept else r.lo
            if not kept or (r.n != kept[-1][0] and t - kept[-1][1] >= least):
                kept.append((r.n, t))
        while len(kept) > 1 and rows["hi"].iloc[0] - kept[-1][1] < least:
            kept.pop()
        yield from kept

    rows = picks.select("key", "n", "t0", "gap").join(scope.select("key", F.col("t0").alias("lo"), F.col("t1").alias("hi")), "key")
    return walked(rows, ["n"], walk, "n long, t long")


def merged(chapters: DataFrame, ends: DataFrame, most: int, least: int, floor: int = 3) -> DataFrame:
    """Chapters (key, t, title) joined until at most ``most`` + 1 remain, each ``least`` long, but never below ``floor``.

    The shortest one joins its shorter neighbour (the earlier of equals); the title of the longer of the two stays, the
    earlier one's of equals.  ``ends`` is (key, t1).
    """

    def walk(rows):
        t, names = [*rows["t"], rows["end"].iloc[0]], list(rows["title"])
        while len(names) > floor:
            lengths = [b - a for a, b in zip(t, t[1:])]
            if len(names) <= most + 1 and min(lengths) >= least:
                break
            j = lengths.index(min(lengths))
            sides = [k for k in (j - 1, j + 1) if 0 <= k < len(names)]
            a = min(j, min(sides, key=lambda k: (lengths[k], k)))
            names[a : a + 2] = [names[a] if lengths[a] >= lengths[a + 1] else names[a + 1]]
            del t[a + 1]
        yield from zip(t, names)

    return walked(chapters.select("key", "t", "title").join(ends.select("key", F.col("t1").alias("end")), "key"), ["t"], walk, "t long, title string")


def issues(chapters: DataFrame, scope: DataFrame, slack: int, least: int, few: int = 3) -> DataFrame:
    """(key, code, t): FEW chapters, a FIRST one that starts late, SHORT ones, and EMPTY titles; t is null for FEW."""
    line = Window.partitionBy("key").orderBy("t")
    rows = chapters.join(scope.select("key", F.col("t0").alias("lo"), F.col("t1").alias("hi")), "key")
    rows = rows.withColumns({"_end": F.coalesce(F.lead("t").over(line), "hi"), "_place": F.row_number().over(line)})
    codes = F.array_compact(
        F.array(
            F.when((F.col("_place") == 1) & (F.col("t") - F.col("lo") > slack), "FIRST"), F.when(F.col("_end") - F.col("t") < least, "SHORT"),
            F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "EMPTY"),
        )
    )
    per = rows.select("key", F.explode(codes).alias("code"), "t")
    count = scope.select("key").join(chapters.groupBy("key").agg(F.count(F.lit(1)).alias("_n")), "key", "left").where(F.coalesce("_n", F.lit(0)) < few)
    return per.unionByName(count.select("key", F.lit("FEW").alias("code"), F.lit(None).cast("long").alias("t")))


def edited(chapters: DataFrame, scope: DataFrame, close: int) -> DataFrame:
    """(key, t, title) of chapters that are on, clamped to the scope; one that is closer than ``close`` to the last kept one goes."""

    def walk(rows):
        last = None
        for r in rows.itertuples(index=False):
            if last is None or r.t - last >= close:
                last = r.t
                yield r.t, r.title

    inside = chapters.where("on").join(scope.select("key", F.col("t0").alias("lo"), F.col("t1").alias("hi")), "key")
    return walked(inside.select("key", F.least(F.greatest("t", "lo"), "hi").alias("t"), "title"), ["t", "title"], walk, "t long, title string")


def keyword_titles(bags: DataFrame, top: int = 3, least: int = 2) -> DataFrame:
    """(key, part, place, token, score): the most telling words of each part of a key, from bags (key, part, token, tf).

    tf * (tf / total) * (1 + ln(parts / parts with it)) in millionths, for words said ``least`` times in the part and, where
    there are several parts, at least two fifths of all their times; then the longer word, then the later by letters.
    """
    word = bags.groupBy("key", "token").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    size = bags.groupBy("key").agg(F.count_distinct("part").alias("parts"))
    rows = bags.where(F.col("tf") >= least).join(word, ["key", "token"]).join(size, "key").where((F.col("parts") == 1) | (5 * F.col("tf") >= 2 * F.col("total")))
    score = F.floor(1e6 * F.col("tf") * F.col("tf") / F.col("total") * (1 + F.log(F.col("parts") / F.col("df"))) + 1e-3).cast("long")
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.desc("score"), F.desc(F.length("token")), F.desc("token")))
    return rows.withColumn("score", score).withColumn("place", place).where(F.col("place") <= top).select("key", "part", "place", "token", "score")


def idf(bags: DataFrame) -> DataFrame:
    """(token, df, idf): ln(1 + documents / documents with it), from bags (key, token)."""
    df = bags.groupBy("token").agg(F.count_distinct("key").alias("df"))
    total = bags.agg(F.count_distinct("key").alias("n"))
    return df.join(F.broadcast(total)).select("token", "df", F.log1p(F.col("n") / F.col("df")).alias("idf"))  # one row is broadcast
