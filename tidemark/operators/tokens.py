"""Operators on words in order: (key, pos, token), one sequence per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import tokens


def line():
    return Window.partitionBy("key").orderBy("pos")


def words(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def nexts(df: DataFrame, n: int) -> Column:
    """The words from here on, ``n`` at most."""
    return F.collect_list("token").over(line().rowsBetween(0, n - 1))


def grams(df: DataFrame, n: int) -> DataFrame:
    """(key, pos, gram): every n consecutive words."""
    return df.select("key", "pos", nexts(df, n).alias("_w")).where(F.size("_w") == n).select("key", "pos", F.array_join("_w", " ").alias("gram"))


def stutters(df: DataFrame) -> DataFrame:
    """Words that repeat the one before: (key, pos, token)."""
    return df.withColumn("_b", F.lag("token").over(line())).where("_b = token").drop("_b")


def repeated_grams(df: DataFrame, n: int, within: int) -> DataFrame:
    """Grams that come again up to ``within`` words later: (key, gram, pos, next_pos)."""
    after = F.lead("pos").over(Window.partitionBy("key", "gram").orderBy("pos"))
    return grams(df, n).withColumn("next_pos", after).where(F.col("next_pos") - F.col("pos") <= within).select("key", "gram", "pos", "next_pos")


def dense(df: DataFrame, window: int, most_distinct: int) -> DataFrame:
    """Positions whose ``window`` words from there hold at most ``most_distinct`` different ones."""
    seen = F.collect_list("token").over(line().rowsBetween(0, window - 1))
    out = df.select("key", "pos", F.size(seen).alias("n"), F.size(F.array_distinct(seen)).alias("n_distinct"))
    return out.where((F.col("n") == window) & (F.col("n_distinct") <= most_distinct)).select("key", "pos", "n_distinct")


def phrases(df: DataFrame, starts: Column) -> DataFrame:
    """Words cut into phrases wherever ``starts`` holds: (key, phrase, p0, p1, text)."""
    cut = df.withColumn("_s", F.lag("pos").over(line()).isNull() | F.coalesce(starts, F.lit(False))).withColumn("phrase", F.sum(F.col("_s").cast("int")).over(line()))
    one = F.sort_array(F.collect_list(F.struct("pos", "token")))
    out = cut.groupBy("key", "phrase").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"), one.alias("_w"))
    return out.select("key", "phrase", "p0", "p1", F.array_join(F.col("_w.token"), " ").alias("text"))


#: Entries of a list up to which it is broadcast; longer ones are joined by shuffling.
BROADCAST = 100_000


def listed(entries: DataFrame) -> DataFrame:
    """``entries``, broadcast when they are counted and few."""
    return F.broadcast(entries) if entries.limit(BROADCAST + 1).count() <= BROADCAST else entries


def lexicon(df: DataFrame, entries: DataFrame) -> DataFrame:
    """Words found in ``entries`` (token, lemma, tier)."""
    return df.join(listed(entries), "token").select("key", "pos", "token", "lemma", "tier")


def phrase_match(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, pos, phrase): occurrences of phrases (phrase, n words) of any length, from left to right; at a place the
    longest wins, and a match hides those that start inside it.

    One window gathers the words that follow each word, as many as the longest phrase has; the choice is a fold over a
    key's matches in order.
    """
    sizes = sorted(r.n for r in wanted.select("n").distinct().collect())  # the lengths of phrases, a handful
    if not sizes:
        return df.select("key", "pos", F.lit("").alias("phrase")).limit(0)
    ahead = df.select("key", "pos", nexts(df, sizes[-1]).alias("_w"))
    some = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.size("_w"))
    each = ahead.withColumn("n", F.explode(some)).select("key", "pos", "n", F.array_join(F.slice("_w", F.lit(1), F.col("n")), " ").alias("phrase"))
    found = each.join(listed(wanted.select("phrase", "n").distinct()), ["phrase", "n"])
    seen = F.sort_array(F.collect_list(F.struct("pos", (-F.col("n")).alias("minus"), "phrase")))
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<pos:int,phrase:string>>").alias("kept"))
    step = lambda acc, x: F.when(
        x["pos"] >= acc["end"], F.struct((x["pos"] - x["minus"]).alias("end"), F.array_append(acc["kept"], F.struct(x["pos"].alias("pos"), x["phrase"].alias("phrase"))).alias("kept"))
    ).otherwise(acc)
    kept = found.groupBy("key").agg(seen.alias("m")).select("key", F.explode(F.aggregate("m", start, step)["kept"]).alias("x"))
    return kept.select("key", "x.pos", "x.phrase")


def frequencies(df: DataFrame) -> DataFrame:
    return df.groupBy("key", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(df: DataFrame) -> DataFrame:
    return df.groupBy("token").agg(F.count_distinct("key").alias("df"), F.count(F.lit(1)).alias("total"))


def neighbour_overlap(df: DataFrame, block: int) -> DataFrame:
    """Between each block of words and the next: the dot product and norms of their bags, and their cosine in thousandths.

    One shuffle, by key: a word's counts in neighbouring blocks meet in a window.
    """
    at = F.floor(F.col("pos") / block)
    bag = df.where("key is not null and pos is not null").select("key", at.alias("b"), "token").repartition("key").groupBy("key", "b", "token").agg(F.count(F.lit(1)).alias("n"))
    same, blocks = Window.partitionBy("key", "token").orderBy("b"), Window.partitionBy("key").orderBy("b")
    following = lambda c, over: F.when(F.lead("b").over(over) == F.col("b") + 1, F.lead(c).over(over))
    shared = bag.withColumn("n2", F.when(F.col("token").isNotNull(), following("n", same)))
    sums = shared.groupBy("key", "b").agg(F.coalesce(F.sum(F.col("n") * F.col("n2")), F.lit(0)).alias("dot"), F.sum(F.col("n") * F.col("n")).alias("q"))
    both = sums.withColumn("q2", following("q", blocks)).where("q2 is not null")
    return both.withColumn("cosine", F.floor(1000 * F.col("dot") / F.sqrt(F.col("q").cast("double") * F.col("q2")) + 1e-6).cast("long"))
