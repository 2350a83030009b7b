"""Spoken words that sound like a term of a glossary, as a blocked similarity join and a left-to-right choice.

Words are (key, n, text), n from 0 without gaps; terms (term, place): place orders terms that fit alike.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import norm
from tidemark.operators import rank
from tidemark.operators.intervals import shuffled

TRAIL = "[,.?!;:]+$"


def sounded(word: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """The letters and digits of a word in lower case, with every pair's letters replaced in turn."""
    out = norm(word)
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def blocks(sound: Column, short: int = 8) -> Column:
    """Keys such that two strings whose matching blocks cover three quarters of their mean length share one.

    Were all blocks single letters, k of them would need k - 1 unmatched letters between: a ratio of 2k / (3k - 1) at most, under 0.75 from four
    on.  So two alike strings share a pair of letters, or have ``short`` letters together at most and share a letter.
    """
    size = F.length(sound)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substr(sound, i, F.lit(2)))
    letters = F.when(size < short, F.filter(F.split(sound, ""), lambda c: c != "")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.filter(pairs, lambda p: F.length(p) == 2), F.transform(letters, lambda c: F.concat(F.lit("="), c))))


def letters(sound: Column) -> Column:
    """The letters of a string, each with its number among the equal ones: two strings share at most as many letters as these lists do."""
    each = F.filter(F.split(sound, ""), lambda c: c != "")
    return F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def _likeness(parts: str, term: str) -> Column:
    """(whole, single): ratio of the joined parts to the term, and the best ratio of one part alone."""
    of = lambda a, b: SequenceMatcher(None, a, b).ratio()

    @F.pandas_udf("struct<whole: double, single: double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(of("".join(x), y), max(of(p, y) for p in x)) for x, y in zip(a, b)], columns=["whole", "single"])

    return run(parts, term)


def windows(words: DataFrame, pairs: tuple, weak: tuple[str, ...], fillers: tuple[str, ...], most: int = 3) -> DataFrame:
    """(key, n, size, forms, sounds): one to ``most`` words that all have letters; longer windows neither start nor end with a weak
    word, nor start with a filler."""
    line = Window.partitionBy("key").orderBy("n")
    rows = words.select("key", "n", norm(F.col("text")).alias("form"), sounded(F.col("text"), pairs).alias("sound"))
    near = F.collect_list(F.struct("form", "sound")).over(line.rowsBetween(0, most - 1))
    rows = rows.withColumn("_w", near).withColumn("size", F.explode(F.sequence(F.lit(1), F.size("_w")))).withColumn("_w", F.slice("_w", F.lit(1), F.col("size")))
    rows = rows.select("key", "n", "size", F.transform("_w", lambda x: x["form"]).alias("forms"), F.transform("_w", lambda x: x["sound"]).alias("sounds"))
    edge = F.element_at("forms", 1).isin(*weak, *fillers) | F.element_at("forms", -1).isin(*weak)
    return rows.where(F.forall("forms", lambda f: f != "") & ((F.col("size") == 1) | ~edge))


def glossary_matches(words: DataFrame, terms: DataFrame, pairs: tuple, weak: tuple[str, ...], fillers: tuple[str, ...], least: float = 0.75, alone: float = 0.8) -> DataFrame:
    """(key, n, size, term, place, score): every window and every term it sounds like.

    One word: it has the term's letters (a term without capitals has then nothing to correct) or sound, or starts with the
    same letter, differs by one in length and is alike by ``alone``.  More words: none of them is the term, the length
    differs by two or a third of the term at most, and together they are alike by ``least`` and by 0.02 more than any of them alone.

    Only distinct windows are compared, with the terms that share a block key and enough letters in any order; there is no
    product of windows and terms.
    """
    if min(least, alone) < 0.75:
        raise ValueError("the blocks find all pairs alike by 0.75 or more")
    wide = windows(words, pairs, weak, fillers)
    names = terms.select(F.trim("term").alias("term"), "place", norm(F.col("term")).alias("form"), sounded(F.col("term"), pairs).alias("sound")).where("form != ''")
    names = names.groupBy("term").agg(F.min("place").alias("place"), F.first("form").alias("form"), F.first("sound").alias("sound"))
    distinct = wide.select("size", "forms", "sounds").distinct().withColumn("joined", F.array_join("sounds", "")).withColumn("_l", letters(F.col("joined")))
    first = lambda c: F.substring(c, 1, 1)
    keyed = lambda c, more: F.array_union(blocks(c), more)
    # beside the blocks: equal forms and equal sounds, whatever they hold
    left = distinct.withColumn("_k", F.explode(keyed(F.col("joined"), F.array(F.concat(F.lit("s:"), "joined"), F.concat(F.lit("f:"), F.array_join("forms", ""))))))
    right = names.select("term", "place", F.col("form").alias("t_form"), F.col("sound").alias("t_sound"), letters(F.col("sound")).alias("t_l"), F.explode(keyed(F.col("sound"), F.array(F.concat(F.lit("s:"), "sound"), F.concat(F.lit("f:"), "form")))).alias("_k"))
    size, target = F.length("joined"), F.length("t_sound")
    one = (F.col("size") == 1) & ((F.col("joined") == F.col("t_sound")) | (F.element_at("forms", 1) == F.col("t_form")) | ((first("joined") == first("t_sound")) & (F.abs(size - target) <= 1)))
    more = (F.col("size") > 1) & (F.abs(size - target) <= F.greatest(F.lit(2), F.floor(target / 3))) & ~F.array_contains("forms", F.col("t_form"))
    room = 2 * F.size(F.array_intersect("_l", "t_l")) >= 0.75 * (size + target)
    same = (F.col("size") == 1) & ((F.element_at("forms", 1) == F.col("t_form")) | (F.col("joined") == F.col("t_sound")))
    found = left.join(right, "_k").where((one | more) & (room | same)).drop("_k", "_l", "t_l").dropDuplicates(["forms", "sounds", "term"]).withColumn("_r", _likeness("sounds", "t_sound"))
    exact = F.element_at("forms", 1) == F.col("t_form")
    nothing = exact & (F.col("term") == F.lower("term"))
    score = F.when((F.col("size") == 1) & (exact | (F.col("joined") == F.col("t_sound"))), 1.0).otherwise(F.col("_r.whole"))
    found = found.withColumn("score", score)
    good = F.when(F.col("size") == 1, ~nothing & (F.col("score") >= F.when(F.col("score") == 1.0, 1.0).otherwise(alone)))
    good = good.otherwise((F.col("score") >= least) & (F.col("score") >= F.col("_r.single") + 0.02))
    return wide.join(shuffled(found.where(good).select("forms", "sounds", "term", "place", "score")), ["forms", "sounds"]).select("key", "n", "size", "term", "place", "score")


def glossary_fixes(words: DataFrame, terms: DataFrame, pairs: tuple = (), weak: tuple[str, ...] = (), fillers: tuple[str, ...] = (), least: float = 0.75, alone: float = 0.8) -> DataFrame:
    """(key, n, size, text, old): windows to be written as a term, with the last word's punctuation.

    At a word the most alike fit counts, of equals the shorter window, then the term that comes first; from left to right
    the words of a fit start no other.  Fits that already stand as the term are left as they are.
    """
    fits = glossary_matches(words, terms, pairs, weak, fillers, least, alone)
    best = fits.groupBy("key", "n").agg(F.min(F.struct((-F.col("score")).alias("s"), "size", "place", "term")).alias("m"))
    spans = best.select("key", F.lit(0).alias("list"), F.struct("n", "m.term").alias("id"), F.col("n").alias("i"), F.col("m.size").alias("n"))
    kept = rank.first_list_wins(spans).select("key", F.col("i").alias("n"), F.col("n").alias("size"), "id.term")
    line = Window.partitionBy("key").orderBy("n")
    near = words.select("key", "n", F.collect_list(F.trim("text")).over(line.rowsBetween(0, 2)).alias("_w"))
    out = kept.join(shuffled(near), ["key", "n"]).withColumn("_w", F.slice("_w", F.lit(1), F.col("size"))).withColumn("old", F.array_join("_w", " "))
    tail = F.regexp_extract(F.element_at("_w", -1), TRAIL, 0)
    return out.where(F.regexp_replace("old", TRAIL, "") != F.col("term")).select("key", "n", "size", F.concat("term", tail).alias("text"), "old")
