"""Recordings of several speakers: whose channel is whose, what speaks for a shot, and habit words at phrase edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import norm
from tidemark.operators import rank
from tidemark.operators.intervals import overlapping


def source_splits(mics: DataFrame, clips: DataFrame, media: DataFrame) -> DataFrame:
    """(key, media, speaker, mode, part): how to read a file that lies on the microphone tracks of several speakers.

    With a stream for each of them they get the streams in the order of their tracks, else with a channel for each the channels;
    otherwise they share the mix (part null).  Microphones are (key, speaker, track), clips (key, track, media), media
    (media, streams, channels); a file that only one speaker uses has no row.  Unknown media count as without streams.
    """
    users = clips.select("key", "track", "media").distinct().join(mics.select("key", "speaker", "track"), ["key", "track"])
    users = users.groupBy("key", "media", "speaker").agg(F.min("track").alias("track"))
    same = Window.partitionBy("key", "media")
    users = users.withColumns({"n": F.count(F.lit(1)).over(same), "part": F.row_number().over(same.orderBy("track", "speaker")) - 1}).where("n > 1")
    rows = users.join(media.select("media", "streams", "channels"), "media", "left")
    mode = F.when(F.col("streams") >= F.col("n"), "stream").when(F.col("channels") >= F.col("n"), "channel").otherwise("shared")
    return rows.select("key", "media", "speaker", mode.alias("mode"), F.when(mode != "shared", F.col("part")).alias("part"))


def shot_evidence(shots: DataFrame, runs: DataFrame, wide: str = "wide", bucket: int = 4096) -> DataFrame:
    """Shots (key, t0, t1, camera, why) with kind and conf, thousandths of their frames that speak for them.

    ``runs`` is (key, label, i0, i1), who speaks when.  A speaker's shot has the share of talk (speakers and crosstalk) that is the
    speaker's; the wide camera that of crosstalk or silence in the whole shot, when that is why it is on; reactions, asides and shots without
    talk have none.
    """
    near = overlapping(shots, runs.select("key", F.col("i0").alias("t0"), F.col("i1").alias("t1"), "label"), bucket)
    size = F.least("t1", "b_t1") - F.greatest("t0", "b_t0")
    add = lambda test: F.coalesce(F.sum(F.when(test, size)), F.lit(0))
    label = F.col("b_label")
    sums = near.groupBy("key", "t0", "t1", "camera", "why").agg(
        add(label == F.col("camera")).alias("own"), add(~label.isin("silent", "unknown")).alias("talk"), add(label == "cross").alias("cross"), add(label == "silent").alias("silent"), F.sum(size).alias("all")
    )
    rows = shots.select("key", "t0", "t1", "camera", "why").join(sums, ["key", "t0", "t1", "camera", "why"], "left")
    kind = F.when(F.col("camera") == wide, "wide").when(F.col("why").isin("reaction", "aside"), "react").otherwise("speaker")
    share = lambda a, b: F.when(F.col(b) > 0, F.floor((2000 * F.col(a) + F.col(b)) / (2 * F.col(b))).cast("int"))
    conf = F.when(kind == "speaker", share("own", "talk")).when((kind == "wide") & (F.col("why") == "crosstalk"), share("cross", "all")).when((kind == "wide") & (F.col("why") == "silence"), share("silent", "all"))
    return rows.select("key", "t0", "t1", "camera", "why", kind.alias("kind"), conf.alias("conf"))


def first_words(spans: DataFrame, words: DataFrame, most: int = 10, letters: int = 80, bucket: int = 60_000) -> DataFrame:
    """Spans (key, t0, t1, ...) with ``text``: their first words (key, n, t0, t1, text), empty where there are none."""
    near = overlapping(spans.select("key", "t0", "t1"), words.select("key", "n", "t0", "t1", "text"), bucket)
    order = F.slice(F.sort_array(F.collect_list(F.struct("b_n", F.trim("b_text").alias("w")))), 1, most)
    said = near.groupBy("key", "t0", "t1").agg(F.substring(F.array_join(F.transform(order, lambda x: x["w"]), " "), 1, letters).alias("text"))
    return spans.join(said, ["key", "t0", "t1"], "left").withColumn("text", F.coalesce("text", F.lit("")))


@dataclass(frozen=True)
class Habits:
    """Habit words in normalised form: phrases of searching; openers and closers by word, with the name that turns them on; pairs (opener's name,
    next word) and (closer, next word) that go together; words after which a closer belongs to the sentence."""

    searches: tuple[tuple[str, ...], ...] = ()
    openers: dict[str, str] = field(default_factory=dict)
    closers: dict[str, str] = field(default_factory=dict)
    opening_pairs: frozenset = frozenset()
    closing_pairs: frozenset = frozenset()
    never_after: frozenset = frozenset()


def habit_words(words: DataFrame, habits: Habits, enabled: frozenset[str], pause: int = 250) -> DataFrame:
    """(key, n, size, kind, name): habit words at the edges of phrases, from left to right; a hit's words are in no other.

    A search phrase counts where a phrase starts and something follows; then an opener where one starts and something other than an
    opener follows (with a word of an opening pair, both, if that word is enabled, too, and more follows); then a closer where a phrase ends, not as the
    first word and not after a word that needs it (of a closing pair both, where the pair ends one; alone it then counts not).
    A phrase starts or ends at either end, a pause over ``pause``, a segment's end and punctuation.
    """
    line = Window.partitionBy("key").orderBy("n")
    longest = max([2, *map(len, habits.searches)])
    rows = words.select("key", "n", norm(F.col("text")).alias("w"), F.trim("text").rlike("[.?!,]$").alias("mark"), F.coalesce("seg", F.lit(False)).alias("seg"), "t0", "t1")
    gap = F.lead("t0").over(line) - F.col("t1")
    rows = rows.withColumn("ends", gap.isNull() | (gap > pause) | F.col("seg") | F.col("mark"))
    rows = rows.withColumns({"starts": F.coalesce(F.lag("ends").over(line), F.lit(True)), "before": F.lag("w").over(line), "p": (F.row_number().over(line) - 1).cast("long"), "_n": F.collect_list(F.struct("w", "ends")).over(line.rowsBetween(0, longest))})
    word = lambda k: F.try_element_at("_n", F.lit(k + 1))["w"]
    follows = lambda k: F.size("_n") > k
    hit = lambda size, kind, name: F.struct(F.lit(size).alias("size"), F.lit(kind).alias("kind"), name.alias("name"))
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")

    def named(d: dict[str, str]) -> Column:
        name = F.try_element_at(table(d), F.col("w"))
        return F.when(name.isin(*enabled), name) if enabled else F.lit(None).cast("string")

    one_of = lambda c, some: c.isin(*some) if some else F.lit(False)
    paired = lambda a, pairs: one_of(F.concat_ws(" ", a, word(1)), {" ".join(p) for p in pairs})
    options = []
    for phrase in habits.searches:
        if " ".join(phrase) in enabled:
            same = F.transform(F.slice("_n", 1, len(phrase)), lambda x: x["w"]) == F.array(*map(F.lit, phrase))
            options.append(F.when(same & follows(len(phrase)) & F.col("starts"), hit(len(phrase), "search", F.lit(" ".join(phrase)))))
    opener, closer = named(habits.openers), named(habits.closers)
    opens = opener.isNotNull() & follows(1) & F.col("starts")
    known = one_of(word(1), habits.openers)
    options.append(F.when(opens & ~known, hit(1, "transition", opener)))
    options.append(F.when(opens & known & paired(opener, habits.opening_pairs) & one_of(word(1), enabled) & follows(2), hit(2, "transition", opener)))
    closes = closer.isNotNull() & F.col("before").isNotNull() & ~one_of(F.col("before"), habits.never_after)
    both = F.coalesce(paired(F.col("w"), habits.closing_pairs), F.lit(False))
    options.append(F.when(closes & both & one_of(word(1), enabled) & F.try_element_at("_n", F.lit(2))["ends"], hit(2, "tag", closer)))
    options.append(F.when(closes & ~both & F.col("ends"), hit(1, "tag", closer)))
    found = rows.withColumn("_h", F.coalesce(*options)).where("_h is not null")
    kept = rank.first_list_wins(found.select("key", F.lit(0).alias("list"), F.struct("n", "_h.kind", "_h.name").alias("id"), F.col("p").alias("i"), F.col("_h.size").alias("n")))
    return kept.select("key", "id.n", F.col("n").alias("size"), "id.kind", "id.name")
