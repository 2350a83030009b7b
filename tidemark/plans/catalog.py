"""All queries over the driver tables, by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import algebra, cuts, matched, moving, ordered, pictures, relational, scoring, signals, spoken, stateful, takes, talking, text, timeline, topics, wording

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for part in (algebra, ordered, scoring, text, stateful, relational, timeline, spoken, signals, topics, cuts, pictures, wording, takes, matched, moving, talking):
    QUERIES |= {name: query for name, (query, _) in part.ALL.items()}
    ORACLE_SQL |= {name: sql for name, (_, sql) in part.ALL.items() if sql}
