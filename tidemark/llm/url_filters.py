"""URL filters: host-suffix and path-prefix rules matched by hash prefixes, full digests and precedence.

A rule has a host and a path.  It fits its host and every subdomain when the URL's path starts with the
rule's path.  Each URL is expanded into the strings host suffix + path prefix (of the lengths that rules have,
so a host of many labels costs no more than others); the strings' short hash prefixes are equi-joined with the rules', full SHA-256 digests
confirm, and the longest rule wins (then the longer host, then the rule's text, then block over allow).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: from there up
to ``?``, ``#`` or the end.  A null URL or one without ``://`` has an empty host and path; no rule fits an
empty host.  URLs that no rule fits get the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Rules up to this many are broadcast; more are joined by shuffling the expanded URLs.
BROADCAST_RULES = 20_000
#: A pair of host and path is hot when one page in so many has it; at most so many pairs can be hot, and they are broadcast.
HOT = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as the table that url_verdicts takes."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (its text, or null), verdict.

    Repeated rows keep a row each; each distinct host and path is expanded and judged once.
    """
    text = F.concat("host", "path")
    digest = F.sha2(text, 256)
    ruled = (
        rules.where(F.length("host") > 0)
        .select(text.alias("rule"), digest.alias("digest"), F.length("host").alias("rule_host"), F.col("path"), F.col("verdict").alias("rule_verdict"))
        .dropDuplicates()
    )
    size = lambda c: F.array_sort(F.collect_set(F.length(c)))
    sizes = ruled.agg(F.count(F.lit(1)).alias("n"), size("path").alias("lengths"), F.array_sort(F.collect_set("rule_host")).alias("host_lengths")).first()
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    # equal host and path have equal verdicts: judge each pair once, whatever number of pages share it
    pairs = base.where(F.length("host") > 0).groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    pairs = written(pairs, "op6-pairs")
    whole = pairs.agg(F.sum("pages")).first()[0] or 0

    array = lambda values: F.array(*(F.lit(n) for n in values)) if values else F.array().cast("array<int>")
    rest = lambda n: F.substr(F.col("host"), F.length("host") - n + 1, n)
    dotted = lambda n: F.substr(F.col("host"), F.length("host") - n, F.lit(1)) == "."
    suffixes = F.transform(F.filter(array(sizes["host_lengths"]), lambda n: (n == F.length("host")) | ((n < F.length("host")) & dotted(n))), rest)
    fitting = F.filter(array(sizes["lengths"]), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substr(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = pairs.select("host", "path", F.explode(F.array_distinct(expressions)).alias("expression"))
    asked = asked.select("host", "path", F.sha2("expression", 256).alias("asked")).withColumn("short", F.substring("asked", 1, 8))
    short = ruled.drop("path").withColumn("short", F.substring("digest", 1, 8))
    if sizes["n"] <= BROADCAST_RULES:
        short = F.broadcast(short)
    best = (
        asked.join(short, "short")
        .where(F.col("asked") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule_host", "rule", F.col("rule_verdict").alias("v"))).alias("best"))
        .select("host", "path", "best.rule", F.col("best.v").alias("_v"))
    )
    # every hot pair is broadcast with its verdict; the others are not frequent, so the shuffle by pair has no large group
    hot = F.col("pages") * HOT >= whole
    judged = written(pairs.select("host", "path", hot.alias("hot")).join(best.hint("merge"), ["host", "path"], "left"), "op6-judged")
    often = F.broadcast(judged.where("hot").drop("hot"))
    hosted = base.where(F.length("host") > 0)
    frequent = hosted.join(often, ["host", "path"])
    others = hosted.join(often, ["host", "path"], "left_anti").join(judged.where("not hot").drop("hot").hint("merge"), ["host", "path"])
    hostless = base.where(F.length("host") == 0).withColumns({"rule": F.lit(None).cast("string"), "_v": F.lit(None).cast("string")})
    columns = [F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_v", F.lit(default)).alias("verdict")]
    return frequent.select(*columns).unionByName(others.select(*columns)).unionByName(hostless.select(*columns))
