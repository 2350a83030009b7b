"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, written


def _mins(pairs: DataFrame, keep: Scratch) -> DataFrame:
    return keep.written(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m"), "components-min")


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that can be reached.

    Each round joins every node's neighbours to the smallest of them (larger neighbours first, then smaller
    ones) until the edges are stars around roots; rounds grow with the logarithm of a component's size.
    """
    with Scratch(links.sparkSession, "components") as keep:
        edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
        edges = keep.written(edges, "components")
        before = _mark(edges)
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = _mins(both, keep)
            large = both.join(low, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.least("m", "_u").alias("v"))
            large = keep.written(large.distinct(), "components-large")
            low = _mins(large, keep)
            small = large.join(low, F.col("u") == F.col("_u")).select("u", "v", "m")
            small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v")))
            edges = keep.written(small.where("u != v").distinct(), "components")
            after = _mark(edges)
            if after == before:
                break
            before = after
        stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return written(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "components-roots")
