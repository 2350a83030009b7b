"""Queries over caption pages, glossary terms and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import norm
from tidemark.operators import captions as cp
from tidemark.operators import glossary as gl
from tidemark.operators import quotes as qt
from tidemark.plans import spoken, topics
from tidemark.plans.inputs import SPOKEN

LOOK = cp.Look(weak_words=frozenset(["the", "a", "to", "of", "and", "de", "la", "in", "your"]))
PAIRS = (("ph", "f"), ("oe", "u"), ("q", "k"), ("x", "ks"))
WEAK, FILLERS = ("the", "a", "to", "of", "and"), ("um", "uh")


def captioned(s, d):
    n = F.col("n")
    return spoken.spoken(s, d).withColumn("brk", F.when(n % 37 == 5, "page").when(n % 41 == 7, "line").when(n % 43 == 9, "join"))


def terms(s, d):
    """The 60 longer words said most often as a glossary: with a capital, some without their last letter, some with another first one."""
    each = spoken.spoken(s, d).select(norm(F.col("text")).alias("w")).where(F.length("w") >= 6).groupBy("w").count().orderBy(F.desc("count"), "w").limit(60)
    cut = F.pmod(F.crc32("w"), F.lit(3))
    form = F.when(cut == 0, F.expr("left(w, length(w) - 1)")).when(cut == 1, F.concat(F.lit("q"), F.expr("substring(w, 2)"))).otherwise(F.col("w"))
    return each.select(F.initcap(form).alias("term"), F.crc32("w").alias("place"))


def asks(s, d):
    """Every fifth sentence asked for by its first words, some misspelt, some left out, at a time that is off."""
    rows = topics.sentences(s, d).where("n % 5 = 2")
    n = F.col("n")
    quote = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    said = F.when(n % 15 == 2, F.translate(quote, "ea", "ae")).when(n % 20 == 7, None).when(n % 35 == 12, "nothing like this was said").otherwise(quote)
    at = F.when(n % 25 != 22, F.col("t0") + (n * 7919) % 30_000 - 15_000)
    return rows.select("key", n.alias("id"), at.alias("t"), said.alias("quote"), F.when(n % 10 == 2, n - 20).alias("after"))


def chunks(s, d):
    w = spoken.spoken(s, d).withColumns({"page": F.floor(F.col("n") / 6), "line": F.floor(F.col("n") % 6 / 3)})
    order = F.sort_array(F.collect_list(F.struct("n", "text")))
    return w.groupBy("key", "page", "line").agg(F.min("n").alias("w0"), F.max("n").alias("w1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"))


def standing(s, d):
    """Every page of three sentences with five heights and what stands there."""
    rows = topics.sentences(s, d).select("key", "n", "t0", "t1", F.explode(F.array(*map(F.lit, (20.0, 35.0, 50.0, 65.0, 80.0)))).alias("y"))
    place = F.pmod(F.hash("key", F.floor(F.col("n") / 3), "y"), F.lit(100))
    return rows.select("*", F.when(place < 15, place / 15).alias("face"), (F.pmod(place, F.lit(30)) / 40).alias("text"), F.when(place > 80, 0.3).alias("action"), F.when(F.col("n") % 11 == 5, 35.0).alias("fixed"))


ALL = {
    "caption_heights": (lambda s, d: cp.caption_heights(standing(s, d)), None),
    "caption_pages": (lambda s, d: cp.caption_pages(captioned(s, d), LOOK), None),
    "page_flags": (
        lambda s, d: cp.page_flags(chunks(s, d), spoken.spoken(s, d).select("key", "n", (F.col("n") * 31 % 100 / 100).alias("p")), 9.0),
        f"""with {SPOKEN} select key, n // 6 as page, floor((sum(length(text)) + count(*) - 1) * 1000 / greatest(max(t1) - min(t0), 1) * 10 + 0.5) / 10 as cps,
          floor((sum(length(text)) + count(*) - 1) * 1000 / greatest(max(t1) - min(t0), 1) * 10 + 0.5) / 10 > 9 as fast, count(*) filter (n * 31 % 100 < 50) as unsure from spoken group by key, n // 6""",
    ),
    "glossary_fixes": (lambda s, d: gl.glossary_fixes(spoken.spoken(s, d), terms(s, d), PAIRS, WEAK, FILLERS), None),
    "resolved_quotes": (lambda s, d: qt.resolved(asks(s, d), topics.sentences(s, d)), None),
}
