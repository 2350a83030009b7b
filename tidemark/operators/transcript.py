"""Words in time: clean-up of transcripts, phrases, sentences, loops, and the sound under words.

A word is (key, n, text, t0, t1, seg): its place from 0 without gaps, its raw text, BIGINT times and whether it ends a
segment.  A sounding signal is (key, i): the frames of ``hop`` time units that sound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import norm
from tidemark.operators.intervals import islands, overlapping, shuffled, subtract
from tidemark.operators.sequences import walked
from tidemark.operators.series import sounding_runs


def line():
    return Window.partitionBy("key").orderBy("n")


def phrases(words: DataFrame, pause: int, ends: str = "[.?!]$") -> DataFrame:
    """(key, phrase, w0, w1, t0, t1): words cut after a segment's end, closing punctuation, or a pause of ``pause`` at least."""
    before = lambda c: F.lag(c).over(line())
    cut = before("seg") | before("text").rlike(ends) | (F.col("t0") - before("t1") >= pause)
    rows = words.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("phrase", F.sum("_cut").over(line()))
    return rows.groupBy("key", "phrase").agg(F.min("n").alias("w0"), F.max("n").alias("w1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))


def segments(words: DataFrame) -> DataFrame:
    """``words`` with the number of their segment."""
    ended = F.coalesce(F.lag("seg").over(line()), F.lit(False)).cast("int")
    return words.withColumn("_e", ended).withColumn("segment", F.sum("_e").over(line())).drop("_e")


def segment_loops(words: DataFrame, times: int = 4, letters: int = 4) -> DataFrame:
    """(key, segment, token, n): segments where one word of letters, long enough, comes ``times`` or more and is over half of all."""
    rows = segments(words).withColumn("token", norm(F.col("text"))).where("token != ''")
    size = rows.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("_all"))
    each = rows.where((F.length("token") >= letters) & F.col("token").rlike(r"^\p{L}+$")).groupBy("key", "segment", "token").agg(F.count(F.lit(1)).alias("n"))
    return each.where(F.col("n") >= times).join(size, ["key", "segment"]).where(F.col("n") * 2 > F.col("_all")).drop("_all")


def dense_loops(words: DataFrame, window: int = 12, time: int = 15_000, times: int = 4, distinct: int = 5, letters: int = 4) -> DataFrame:
    """(key, n, last): words that come ``times`` or more in the ``window`` words and the ``time`` from them, among at most
    ``distinct`` different ones up to the last time; ``last`` is its place.  Numbers repeat for good reason and do not count."""
    near = F.collect_list(F.struct("n", "token", "t0")).over(line().rowsBetween(0, window - 1))
    rows = words.withColumn("token", norm(F.col("text"))).withColumn("_w", near)
    rows = rows.where((F.length("token") >= letters) & F.col("token").rlike(r"^\p{L}+$"))
    rows = rows.withColumn("_w", F.filter("_w", lambda x: x["t0"] - F.col("t0") < time)).withColumn("_same", F.filter("_w", lambda x: x["token"] == F.col("token")))
    rows = rows.where(F.size("_same") >= times).withColumn("last", F.element_at("_same", -1)["n"])
    upto = F.array_distinct(F.transform(F.filter("_w", lambda x: x["n"] <= F.col("last")), lambda x: x["token"]))
    return rows.where(F.size(upto) <= distinct).select("key", "n", "last")


def repeats(tokens: list[str], n: int, joined: list[bool]) -> list[int]:
    """For each place how often the ``n`` words there come back to back; ``joined[j]``: word j may follow the one before."""
    out = [1] * len(tokens)
    for i in range(len(tokens) - 2 * n, -1, -1):
        if tokens[i : i + n] == tokens[i + n : i + 2 * n] and joined[i + n]:
            out[i] = 1 + out[i + n]
    return out


def back_to_back(words: DataFrame, least: dict[int, int], gap: int | None = None) -> DataFrame:
    """(key, n, size, times): from left to right the runs of ``size`` words said ``least[size]`` times or more in a row.

    At a place the size that covers most words wins, the smaller of equals; a run's words start no other run.  With
    ``gap`` a repetition starts less than that after the word before.  Words without letters or digits are never part.
    """

    def walk(rows):
        tokens, t0, t1, at = rows["token"].tolist(), rows["t0"].tolist(), rows["t1"].tolist(), rows["n"].tolist()
        joined = [gap is None or j == 0 or t0[j] - t1[j - 1] < gap for j in range(len(tokens))]
        times = {n: repeats(tokens, n, joined) for n in least}
        i = 0
        while i < len(tokens):
            fits = [(n * times[n][i], -n) for n in least if times[n][i] >= least[n] and all(tokens[i : i + n])]
            if fits:
                covered, n = max(fits)[0], -max(fits)[1]
                yield at[i], n, covered // n
                i += covered
            else:
                i += 1

    rows = words.select("key", "n", norm(F.col("text")).alias("token"), "t0", "t1")
    return walked(rows, ["n"], walk, "n long, size int, times int")


def sentences(words: DataFrame, gap: int, longest: int, least: int, ends: str = ".?!") -> DataFrame:
    """(key, w0, w1, t0, t1): a sentence ends after closing punctuation, before a pause of ``gap``, after a segment's end
    once it has ``least`` words or the next word would end past ``longest``, and before it lasts over twice ``longest``."""

    def walk(rows):
        open_ = None
        for r in rows.itertuples(index=False):
            if open_ is not None:
                length = r.t1 - open_.t0
                if last.text[-1:] in ends and last.text or r.t0 - last.t1 >= gap or length > 2 * longest or (last.seg and (r.n - open_.n >= least or length > longest)):
                    yield open_.n, last.n, open_.t0, last.t1
                    open_ = None
            open_, last = open_ or r, r
        if open_ is not None:
            yield open_.n, last.n, open_.t0, last.t1

    return walked(words.select("key", "n", "text", "t0", "t1", "seg"), ["n"], walk, "w0 long, w1 long, t0 long, t1 long")


def caption_lines(words: DataFrame, characters: int, gap: int, longest: int, ends: str = ".?!") -> DataFrame:
    """(key, w0, w1, text): lines of at most ``characters`` that no pause over ``gap``, segment's end or closing
    punctuation interrupts and that last at most ``longest``; a longer word has a line of its own."""

    def walk(rows):
        held = []
        for r in rows.itertuples(index=False):
            if held:
                last, text = held[-1], " ".join(x.text for x in held)
                if len(text) + 1 + len(r.text) > characters or r.t0 - last.t1 > gap or r.t1 - held[0].t0 > longest or last.seg or last.text[-1:] in ends:
                    yield held[0].n, last.n, text
                    held = []
            held.append(r)
        if held:
            yield held[0].n, held[-1].n, " ".join(x.text for x in held)

    return walked(words.select("key", "n", "text", "t0", "t1", "seg"), ["n"], walk, "w0 long, w1 long, text string")


def joined_continuations(words: DataFrame) -> DataFrame:
    """Words whose text does not start with a space belong to the one before, unless that one (so far) holds a segment's
    end and the text is capitalised: (key, n, text, t0, t1, seg) of the joined words, n of the first part."""

    def walk(rows):
        held = None
        for r in rows.itertuples(index=False):
            if held and r.text and not r.text[0].isspace() and not (held[4] and r.text[0].isupper()):
                held = [held[0], held[1] + r.text, held[2], max(held[3], r.t1), held[4] or r.seg]
                continue
            if held:
                yield tuple(held)
            held = [r.n, r.text if r.text.startswith(" ") else " " + r.text.lstrip(), r.t0, r.t1, r.seg]
        if held:
            yield tuple(held)

    return walked(words.select("key", "n", "text", "t0", "t1", "seg"), ["n"], walk, "n long, text string, t0 long, t1 long, seg boolean")


def kept_segments(segments: DataFrame, stock: str, quiet: float = 0.6, poor: float = -1.0, packed: float = 2.4, logprob: float = -0.7, prob: float = 0.5) -> DataFrame:
    """Segments (no_speech, logprob, compression, prob, text) that are speech: neither silent and poor, nor packed,
    unlikely, unsure or a stock phrase.  A null prob (no words) is not speech."""
    bad = ((F.col("no_speech") > quiet) & (F.col("logprob") < poor)) | (F.col("compression") > packed) | (F.col("logprob") < logprob)
    return segments.where(~bad & (F.col("prob") >= prob) & ~F.coalesce(F.col("text"), F.lit("")).rlike(stock))


def shown_words(words: DataFrame) -> DataFrame:
    """(key, n, shown): the user's text, else the automatic one, else the raw one; masked where censored by choice, or by
    rule without a choice; hidden words are left out."""
    text = F.coalesce("user_text", "auto_text", "text")
    stars = F.repeat(F.lit("*"), F.length(text))
    return words.where(~F.coalesce("hidden", F.lit(False))).select("key", "n", F.when(F.coalesce("censor", "rule_censor", F.lit(False)), stars).otherwise(text).alias("shown"))


# ---- sound under words -----------------------------------------------------------------------------


def _sounding(frames: DataFrame) -> DataFrame:
    """(key, t0, t1): runs of sounding frames, in frames."""
    return shuffled(islands(sounding_runs(frames)))


def _in_frames(spans: DataFrame, hop: int, whole: bool) -> DataFrame:
    """Spans in frames: from the frame of t0 to the one of t1, that one included where ``whole``."""
    a, b = F.floor(F.col("t0") / hop).cast("long"), F.floor(F.col("t1") / hop).cast("long")
    return spans.select("key", "n", a.alias("t0"), (b + 1 if whole else F.greatest(b, a + 1)).alias("t1"))


def sounding_share(spans: DataFrame, frames: DataFrame, hop: int) -> DataFrame:
    """(key, n, share): the part of a span's frames that sound, in thousandths, one frame at least."""
    inside = _in_frames(spans, hop, False)
    pairs = overlapping(inside, _sounding(frames), 512).groupBy("key", "n").agg(F.sum(F.least("t1", "b_t1") - F.greatest("t0", "b_t0")).alias("_on"))
    share = F.floor(1000 * F.coalesce("_on", F.lit(0)) / (F.col("t1") - F.col("t0"))).cast("long")
    return inside.join(shuffled(pairs), ["key", "n"], "left").select("key", "n", share.alias("share"))


def audible_loss(spans: DataFrame, frames: DataFrame, cuts: DataFrame, hop: int, least: int = 3) -> DataFrame:
    """(key, n, loss): the part of a span's sounding frames that cuts (key, t0, t1) remove, in thousandths; null where
    fewer than ``least`` frames sound."""
    heard = overlapping(_in_frames(spans, hop, True), _sounding(frames), 512).select("key", "n", F.greatest("t0", "b_t0").alias("t0"), F.least("t1", "b_t1").alias("t1"))
    gone = islands(cuts.select("key", F.floor(F.col("t0") / hop).cast("long").alias("t0"), F.floor(F.col("t1") / hop).cast("long").alias("t1")))
    lost = overlapping(heard, shuffled(gone), 512).groupBy("key", "n").agg(F.sum(F.least("t1", "b_t1") - F.greatest("t0", "b_t0")).alias("_lost"))
    all_ = heard.groupBy("key", "n").agg(F.sum(F.col("t1") - F.col("t0")).alias("_all"))
    rows = spans.select("key", "n").join(shuffled(all_), ["key", "n"], "left").join(shuffled(lost), ["key", "n"], "left")
    return rows.select("key", "n", F.when(F.col("_all") >= least, F.floor(1000 * F.coalesce("_lost", F.lit(0)) / F.col("_all"))).cast("long").alias("loss"))


def audible_edges(spans: DataFrame, frames: DataFrame, hop: int) -> DataFrame:
    """(key, n, first, last): start of a span's first sounding frame and end of its last one; null where none sounds."""
    pairs = overlapping(_in_frames(spans, hop, True), _sounding(frames), 512)
    edges = pairs.groupBy("key", "n").agg((F.min(F.greatest("t0", "b_t0")) * hop).alias("first"), (F.max(F.least("t1", "b_t1")) * hop).alias("last"))
    return spans.select("key", "n").join(shuffled(edges), ["key", "n"], "left")


def destretched(words: DataFrame, frames: DataFrame, hop: int, pad: int, least_move: int, least: int) -> DataFrame:
    """(key, n, t0, t1): words that start in silence start ``pad`` before their first sounding frame, at most ``least``
    before their end; moves under ``least_move`` and words without sound are left alone."""
    edges = audible_edges(words, frames, hop).select("key", "n", "first")
    rows = words.select("key", "n", "t0", "t1").join(shuffled(edges), ["key", "n"])
    start = F.least(F.greatest("t0", F.col("first") - pad), F.col("t1") - least)
    late = F.floor(F.col("first") / hop) > F.floor(F.col("t0") / hop)
    return rows.select("key", "n", F.when(late & (start - F.col("t0") >= least_move), start).otherwise(F.col("t0")).alias("t0"), "t1")


def uncovered_sound(frames: DataFrame, words: DataFrame, hop: int, bridge: int, least: int, voiced: int, most: int) -> DataFrame:
    """(key, t0, t1, voiced): in frames, sound no word covers, gaps under ``bridge`` closed, spans of ``least`` and
    ``voiced`` sounding frames at least; the first ``most`` of a key."""
    covered = _in_frames(words, hop, True)
    rest = subtract(sounding_runs(frames), shuffled(covered), 512)
    order = Window.partitionBy("key").orderBy("t0")
    new = F.coalesce(F.col("t0") - F.lag("t1").over(order) >= bridge, F.lit(True)).cast("int")
    runs = rest.withColumn("_new", new).withColumn("_r", F.sum("_new").over(order))
    out = runs.groupBy("key", "_r").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum(F.col("t1") - F.col("t0")).alias("voiced"))
    out = out.where((F.col("t1") - F.col("t0") >= least) & (F.col("voiced") >= voiced))
    place = F.row_number().over(order)
    return out.withColumn("_p", place).where(F.col("_p") <= most).select("key", "t0", "t1", "voiced")


def nearest_cut(words: DataFrame, cuts: DataFrame, reach: int) -> DataFrame:
    """(key, n, cut): for each word the cut (key, id, t0, t1) with the smallest gap to it, below ``reach``; of equal ones
    the first by start and id."""
    wide = words.select("key", "n", F.col("t0").alias("w0"), F.col("t1").alias("w1"), (F.col("t0") - reach + 1).alias("t0"), (F.col("t1") + reach - 1).alias("t1"))
    pairs = overlapping(wide, cuts, 60_000)
    gap = F.greatest(F.lit(0), F.col("b_t0") - F.col("w1"), F.col("w0") - F.col("b_t1"))
    best = pairs.where(gap < reach).groupBy("key", "n").agg(F.min(F.struct(gap.alias("gap"), F.col("b_t0").alias("t0"), F.col("b_id").alias("id"))).alias("m"))
    return best.select("key", "n", F.col("m.id").alias("cut"))


def context_in_time(cuts: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """(key, id, pre, post): the last ``n`` words that end before a cut (key, id, t0, t1) and the first that end after it.

    Ends are reliable, starts are stretched into pauses.  One ordered pass numbers the words by end and finds, for each
    edge, how many have ended; the texts are joined by these numbers.
    """
    by_end = Window.partitionBy("key").orderBy("t1", "n")
    ranked = words.select("key", "text", "t1", "n", F.row_number().over(by_end).alias("r"))
    marks = cuts.select("key", "id", F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit("a").alias("e")), F.struct(F.col("t1").alias("t"), F.lit("b").alias("e")))).alias("x"))
    rows = ranked.select("key", F.col("t1").alias("t"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("e"), "r")
    rows = rows.unionByName(marks.select("key", "x.t", F.lit(1).alias("k"), "id", "x.e", F.lit(None).cast("int").alias("r")))
    upto = Window.partitionBy("key").orderBy("t", "k", "r").rowsBetween(Window.unboundedPreceding, 0)
    ended = rows.withColumn("_c", F.coalesce(F.max("r").over(upto), F.lit(0))).where("k = 1")
    both = ended.groupBy("key", "id").agg(F.max(F.when(F.col("e") == "a", F.col("_c"))).alias("a"), F.max(F.when(F.col("e") == "b", F.col("_c"))).alias("b"))
    both = both.withColumn("b", F.greatest("a", "b"))
    places = F.concat(
        F.transform(F.sequence(F.greatest(F.col("a") - n + 1, F.lit(1)), F.greatest("a", F.lit(1))), lambda r: F.struct(r.alias("r"), F.lit(True).alias("pre"))),
        F.transform(F.sequence(F.col("b") + 1, F.col("b") + n), lambda r: F.struct(r.alias("r"), F.lit(False).alias("pre"))),
    )
    asked = both.select("key", "id", "a", F.explode(places).alias("p")).where("not p.pre or p.r <= a").select("key", "id", "p.r", "p.pre")
    found = asked.join(ranked.select("key", "r", "text"), ["key", "r"])
    words_of = lambda pre: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("pre") == pre, F.struct("r", "text")))), lambda x: x["text"]), " ")
    texts = found.groupBy("key", "id").agg(words_of(True).alias("pre"), words_of(False).alias("post"))
    return cuts.select("key", "id").join(texts, ["key", "id"], "left").select("key", "id", F.coalesce("pre", F.lit("")).alias("pre"), F.coalesce("post", F.lit("")).alias("post"))


def filler_cuts(found: DataFrame, pad: int, least: int, pause: int, reach: int, keep: int) -> DataFrame:
    """(key, n, t0, t1): cuts of words (key, n, t0, t1, before, after), with the pause on the larger side up to ``reach``
    but for ``keep``; words under ``least`` without a pause of ``pause`` are left in."""
    rows = found.where((F.col("t1") - F.col("t0") >= least) | (F.greatest("before", "after") >= pause))
    behind = F.col("after") > F.col("before")
    t0 = F.when(behind, F.col("t0") - pad).otherwise(F.col("t0") - F.least("before", F.lit(reach)) + keep)
    t1 = F.when(behind, F.col("t1") + F.least("after", F.lit(reach)) - keep).otherwise(F.col("t1") + pad)
    return rows.select("key", "n", F.greatest(t0, F.lit(0)).alias("t0"), t1.alias("t1"))


def gaps(words: DataFrame, edge: int) -> DataFrame:
    """``words`` with the pauses before and after; ``edge`` at either end of a key."""
    before = F.coalesce(F.col("t0") - F.lag("t1").over(line()), F.lit(edge))
    after = F.coalesce(F.lead("t0").over(line()) - F.col("t1"), F.lit(edge))
    return words.withColumns({"before": before, "after": after})


def clipped_to_gaps(items: DataFrame, words: DataFrame, guard: int, least: int) -> DataFrame:
    """Items (key, n, t0, t1) less every word widened by ``guard``: a word that holds the start moves it, any other cuts
    the end; items of ``least`` or less go."""
    pairs = overlapping(items, words.select("key", (F.col("t0") - guard).alias("t0"), (F.col("t1") + guard).alias("t1")), 60_000)
    holds = F.col("b_t0") <= F.col("t0")
    edges = pairs.groupBy("key", "n").agg(F.max(F.when(holds, F.col("b_t1"))).alias("_a"), F.min(F.when(~holds, F.col("b_t0"))).alias("_b"))
    rows = items.join(edges, ["key", "n"], "left").select("key", "n", F.greatest("t0", "_a").alias("t0"), F.least("t1", "_b").alias("t1"))
    return rows.where(F.col("t1") - F.col("t0") > least)


def voice_activity(words: DataFrame, hold: int, least: int) -> DataFrame:
    """(key, t0, t1): words merged over pauses under ``hold``, spans of ``least`` at least."""
    return islands(words, hold).where(F.col("t1") - F.col("t0") >= least)
