"""Words in use: amounts in figures, ambiguous words judged by their clause, keywords, edits of spans, b-roll slots, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators.intervals import BUCKET, islands, overlapping

#: Marks that may follow a word.
TRAIL = r"[,.?!;:]+$"


def amounts(words: DataFrame, multipliers: dict[str, int], currency: str) -> DataFrame:
    """(key, n, size, text): words (key, n, text) in figures that read better in another form, with their replacement.

    A number before a multiplier is multiplied out when the product is whole, its thousands parted by dots; a currency
    glued to its amount is parted from it.  The marks behind the last word stay.
    """
    line = Window.partitionBy("key").orderBy("n")
    rows = words.select("key", "n", F.trim("text").alias("w"), F.trim(F.lead("text").over(line)).alias("f"))
    core, follow = F.regexp_replace("w", TRAIL, ""), F.regexp_replace("f", TRAIL, "")
    tail = lambda word: F.regexp_extract(word, TRAIL, 0)
    table = F.create_map(*(F.lit(x) for pair in multipliers.items() for x in pair))
    times = F.try_element_at(table, F.lower(follow))
    product = F.when((core == F.col("w")) & core.rlike(r"^[0-9]{1,12}([.,][0-9]{1,6})?$"), F.replace(core, F.lit(","), F.lit(".")).cast("double") * times)
    dotted = F.replace(F.format_number(product.cast("long"), 0), F.lit(","), F.lit("."))
    glued = F.regexp_extract(core, rf"^{currency}\.?([0-9][0-9.,]*)$", 1)
    size = F.when(glued != "", 1).when(product == F.floor(product), 2)
    text = F.when(glued != "", F.concat(F.lit(currency + " "), glued, tail(F.col("w")))).otherwise(F.concat(dotted, tail(F.col("f"))))
    return rows.select("key", "n", size.alias("size"), text.alias("text")).where("size is not null")


def judged(words: DataFrame, hit: Column, strong: tuple[str, ...], before: tuple[str, ...], after: tuple[str, ...], swears: tuple[str, ...], literal: tuple[str, ...], forms, possessive: str) -> DataFrame:
    """(key, n, insult, plain, swear): ambiguous single words (key, n, text, seg) judged by cues in their clause.

    The segment reaches 15 words each way at most, the clause 8, up to a word that ends with a mark.  Insulting are a
    word of ``strong`` (3) or ``before`` (2) in front, ``after`` behind, a stretched letter, a ``!``, a mark after a
    segment's first word, a word alone (2 each), and a swear word beside it (1).  Plain are words of ``literal`` (by
    ``forms``) within three words (2 beside it, else 1; 4 at most), a name (2) and the ``possessive`` ending (1).
    """
    line = Window.partitionBy("key").orderBy("n")
    mark = r"[,.!?;:][^\p{L}\p{N}_]*$"
    rows = words.select("key", "n", F.trim("text").alias("w"), F.coalesce("seg", F.lit(False)).alias("seg"), hit.alias("hit")).withColumn("i", F.row_number().over(line))
    rows = rows.withColumn("k", tx.norm(F.col("w"))).withColumn("ends", F.col("w").rlike(mark)).withColumn("near", F.exists(forms(F.col("k")), lambda f: f.isin(*literal)))
    opens = F.when((F.col("i") == 1) | F.lag("seg").over(line), F.col("i"))
    closes = F.when(F.lead("i").over(line).isNull() | F.col("seg"), F.col("i"))
    starts = F.when(F.lag("ends").over(line), F.col("i"))
    rows = rows.withColumns({"opens": opens, "closes": closes, "starts": starts, "stops": F.when(F.col("ends"), F.col("i"))})
    back = lambda c, r: F.coalesce(F.last(c, ignorenulls=True).over(line.rowsBetween(-r, 0)), F.col("i") - r)
    on = lambda c, r: F.coalesce(F.first(c, ignorenulls=True).over(line.rowsBetween(0, r)), F.col("i") + r)
    side = lambda c, j: (F.lag(c, -j) if j < 0 else F.lead(c, j)).over(line)
    around = {f"{c}{j}".replace("-", "_"): side(c, j) for c, reach in (("near", 3), ("k", 1), ("w", 1)) for j in range(-reach, reach + 1) if j}
    rows = rows.withColumns({"a": back("opens", 15), "b": on("closes", 15), "c0": back("starts", 8), "c1": on("stops", 8), **around}).where("hit")
    rows = rows.withColumns({"c0": F.greatest("a", "c0"), "c1": F.least("b", "c1")})
    front, behind = F.col("i") > F.col("c0"), F.col("i") < F.col("c1")
    points = lambda test, n: F.when(test, n).otherwise(0)
    upper = lambda c: F.substring(c, 1, 1) != F.lower(F.substring(c, 1, 1))
    insult = (
        F.when(front & F.col("k_1").isin(*strong), 3).when(front & F.col("k_1").isin(*before), 2).otherwise(0)
        + points(behind & F.col("k1").isin(*after), 2) + points(F.lower("w").rlike(r"(\p{L})\1{2,}"), 2) + points(F.col("w").endswith("!"), 2)
        + points((F.col("i") == F.col("a")) & (F.col("i") < F.col("b")) & F.col("w").rlike(r"[,.!][^\p{L}\p{N}_]*$"), 2) + points((F.col("i") == F.col("a")) & (F.col("i") == F.col("b")), 2)
        + points((front & F.col("k_1").isin(*swears)) | (behind & F.col("k1").isin(*swears)), 1)
    )
    near = sum((points((F.col("i") - j >= F.col("c0")) & F.col(f"near_{j}"), 2 if j == 1 else 1) + points((F.col("i") + j <= F.col("c1")) & F.col(f"near{j}"), 2 if j == 1 else 1) for j in (1, 2, 3)), F.lit(0))
    name = behind & upper("w") & upper("w1") & ~F.col("k1").isin(*after)
    plain = F.least(F.lit(4), near) + points(name, 2) + points(F.col("k").endswith(possessive), 1)
    return rows.select("key", "n", insult.alias("insult"), plain.alias("plain")).withColumn("swear", F.col("insult") > F.col("plain"))


def line_keywords(words: DataFrame, stop: tuple[str, ...], least: int = 4) -> DataFrame:
    """(key, line, n, text): the word of each line (key, line, n, text) that stands out, the first of equals.

    Letters, 6 for a digit, 3 for a capital that does not begin the line; stop words and short words never.
    """
    first = F.min("n").over(Window.partitionBy("key", "line"))
    k = tx.norm(F.col("text"))
    capital = (F.substring("text", 1, 1) != F.lower(F.substring("text", 1, 1))) & (F.col("n") != F.col("_first"))
    score = F.length("_k") + F.when(F.col("_k").rlike("[0-9]"), 6).otherwise(0) + F.when(capital, 3).otherwise(0)
    rows = words.withColumn("_first", first).withColumn("_k", k).where((F.length("_k") >= least) & ~F.col("_k").isin(*stop))
    best = rows.groupBy("key", "line").agg(F.max(F.struct(score.alias("s"), (-F.col("n")).alias("m"), "text")).alias("b"))
    return best.select("key", "line", (-F.col("b.m")).alias("n"), F.col("b.text").alias("text"))


def span_edits(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Words (key, n, text, t0, t1, seg) after edits (key, first, last, new) of spans that do not overlap, numbered anew.

    As many new words as old ones keep the times, others share the span by their letters; the last of them ends a
    segment if the span did.  An empty text removes its words.
    """
    at = edits.select(F.col("key").alias("_key"), F.col("first").alias("_e"), "new", F.explode(F.sequence("first", "last")).alias("_n"))
    rows = words.join(at, (F.col("key") == F.col("_key")) & (F.col("n") == F.col("_n")), "left")
    kept = rows.where("_e is null").select("key", "n", F.lit(0).alias("p"), "text", "t0", "t1", "seg")
    old = F.sort_array(F.collect_list(F.struct("n", "t0", "t1", "seg")))
    spans = rows.where("_e is not null").groupBy("key", "_e").agg(F.first("new").alias("new"), old.alias("old"))
    spans = spans.withColumn("parts", F.filter(F.split("new", "[ \\n\\t]+"), lambda w: w != "")).withColumn("total", F.length(F.array_join("parts", "")))
    spans = spans.select("*", F.posexplode("parts").alias("p", "text"))
    done = F.length(F.array_join(F.slice("parts", F.lit(1), F.col("p")), ""))
    begin, end, one = F.get("old", F.lit(0))["t0"], F.element_at("old", -1), F.get("old", F.col("p"))
    share = lambda c: begin + F.floor((2 * (end["t1"] - begin) * c + F.col("total")) / (2 * F.col("total"))).cast("long")
    same = F.size("parts") == F.size("old")
    edited = spans.select(
        "key", F.col("_e").alias("n"), "p", "text", F.when(same, one["t0"]).otherwise(share(done)).alias("t0"), F.when(same, one["t1"]).otherwise(share(done + F.length("text"))).alias("t1"),
        F.when(same, one["seg"]).otherwise((F.col("p") + 1 == F.size("parts")) & end["seg"]).alias("seg"),
    )
    place = F.row_number().over(Window.partitionBy("key").orderBy("n", "p")) - 1
    return kept.unionByName(edited).select("key", place.cast("long").alias("n"), "text", "t0", "t1", "seg")


def slot_scores(sentences: DataFrame, stop: tuple[str, ...], good: tuple[str, ...], screen: tuple[str, ...], least: int = 800) -> DataFrame:
    """(key, n, kw, score): sentences (key, n, t0, t1, text) as places for pictures.

    12 for each distinct content word (4 at most), 18 for a good one (2 at most), 8 for 1.5 to 10 seconds, less 22 for a
    word about the screen, within 0 to 100.  The keyword is the first good word, else the first of the longest.
    """
    rows = sentences.where(F.col("t1") - F.col("t0") >= least).withColumn("_c", tx.content_tokens(F.col("text"), stop)).where(F.size("_c") > 0)
    liked = F.filter("_c", lambda w: w.isin(*good))
    ui = F.size(F.filter(tx.tokens(F.col("text")), lambda w: w.isin(*screen)))
    fits = (F.col("t1") - F.col("t0")).between(1500, 10_000)
    score = 12 * F.least(F.size(F.array_distinct("_c")), F.lit(4)) + 18 * F.least(F.size(liked), F.lit(2)) - 22 * ui + F.when(fits, 8).otherwise(0)
    longest = F.array_max(F.transform("_c", lambda w: F.length(w)))
    kw = F.coalesce(F.get(liked, F.lit(0)), F.get(F.filter("_c", lambda w: F.length(w) == longest), F.lit(0)))
    return rows.select("key", "n", kw.alias("kw"), F.least(F.greatest(score, F.lit(0)), F.lit(100)).alias("score"))


def slot_windows(slots: DataFrame, words: DataFrame, scope: DataFrame, frame: int, most: int, least: int, usual: int = 2500, early: int = 80, rest: int = 400) -> DataFrame:
    """(key, id, t0, t1): the picture of each slot (key, id, t0, t1, w0, w1, kw), on frames.

    It starts ``early`` before the first of the slot's words (key, n, t0, text; places w0 to w1) that begins like the
    keyword, else with the slot; it lasts to ``rest`` after it, ``usual`` at least and ``most`` at most, and stays in the
    key's scope (key, t0, t1) with ``least`` of length where that has room.
    """
    stem = F.substring("_kw", F.lit(1), F.greatest(F.lit(3), F.length("_kw") - 2))
    spans = slots.select("key", "id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), F.col("w0").alias("t0"), (F.col("w1") + 1).alias("t1"), tx.norm(F.coalesce("kw", F.lit(""))).alias("_kw")).withColumn("_kw", F.when(F.col("_kw") != "", stem))
    said = words.select("key", F.col("n").alias("t0"), (F.col("n") + 1).alias("t1"), F.col("t0").alias("at"), tx.norm(F.col("text")).alias("k"))
    hits = overlapping(spans, said, 60_000, "b").where(F.startswith("b_k", F.col("_kw"))).groupBy("key", "id").agg(F.min(F.struct("b_t0", "b_at")).alias("m")).select("key", "id", F.col("m.b_at").alias("at"))
    rows = spans.join(hits, ["key", "id"], "left").join(scope.select("key", F.col("t0").alias("lo"), F.col("t1").alias("hi")), "key")
    rows = rows.withColumn("a", F.greatest("s0", F.coalesce(F.col("at") - early, F.col("s0"))))
    want = F.least(F.greatest(F.col("s1") - F.col("a") + rest, F.lit(min(usual, most))), F.lit(most))
    rows = rows.withColumn("_want", want).withColumn("a", F.greatest("lo", "a")).withColumn("b", F.least(F.col("hi"), F.col("a") + F.col("_want")))
    rows = rows.withColumn("a", F.when(F.col("b") - F.col("a") < least, F.greatest(F.col("lo"), F.col("b") - least)).otherwise(F.col("a")))
    on = lambda c: (F.floor((2 * F.col(c) + frame) / (2 * frame)) * frame).cast("long")
    return rows.select("key", "id", on("a").alias("t0"), on("b").alias("t1"))


def speech_spans(words: DataFrame, second: DataFrame, clips: DataFrame, widen: int, least: int, bucket: int = BUCKET) -> DataFrame:
    """(key, t0, t1): where clips speak, from words (key, id, t0, t1) that overlap them, cut to the clip, ``least`` long.

    The rough times of a second source are widened on both sides; touching spans are one.
    """
    rough = second.select("key", "id", (F.col("t0") - widen).alias("t0"), (F.col("t1") + widen).alias("t1"))
    pairs = overlapping(words.select("key", "id", "t0", "t1").unionByName(rough), clips, bucket)
    t0 = F.greatest("t0", "b_t0")
    return islands(pairs.select("key", t0.alias("t0"), F.greatest(F.least("t1", "b_t1"), t0 + least).alias("t1")))


def advice(noise: Column, loudness: Column, peak: Column) -> Column:
    """What to tell about a recording: noise over -60 dB, quieter than -24 LUFS, peaks over -0.5 dB; nulls say nothing."""
    return F.array_compact(F.array(F.when(noise > -60, F.lit("noise")), F.when(loudness < -24, F.lit("quiet")), F.when(peak > -0.5, F.lit("peak"))))


def markers(items: DataFrame, frame: int) -> DataFrame:
    """(key, rank, t0, t1, name, color): items (key, id, t0, t1, score, title, on) that are on, best first.

    Edges go outward to frames; the colour is 0 from a score of 80, 4 from 60, else 3.
    """
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "t0", "id"))
    rows = items.where("on").withColumn("rank", rank)
    name = F.format_string("Clip %02d (%d) %s", F.col("rank"), F.col("score"), F.col("title"))
    color = F.when(F.col("score") >= 80, 0).when(F.col("score") >= 60, 4).otherwise(3)
    out = lambda c, edge: (edge(F.col(c) / frame) * frame).cast("long")
    return rows.select("key", "rank", out("t0", F.floor).alias("t0"), out("t1", F.ceil).alias("t1"), F.substring(name, 1, 120).alias("name"), color.alias("color"))
