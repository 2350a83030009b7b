"""From raw documents to packed training batches: one function per stage, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, packing, pii, quality_gbt
from tidemark.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, null and repeated ids are judged by their texts."""
    return quality_gbt.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row, that of the smallest id, whether ids repeat or are missing.

    Rows without words are components of their own.
    """
    return jaccard_join.one_of_each(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars follows the new text, null texts and n_chars stay null."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their rows in the mixed order; a null source is a source of its own, repeated ids keep a row each."""
    return mixing.mixed_rows(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their bucket, batch and place; a bucket's batches are filled in the mixed order.

    Null texts have no tokens and are packed with the shortest; repeated and null ids keep a row each.
    """
    return packing.packed_rows(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", pii_redaction),
    ("mixing sources to target weights", source_mixing),
    ("packing", length_packing),
]

#: Trained trees, set joins and validated spans are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
    return docs
