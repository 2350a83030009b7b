"""Every catalogue query against its SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from tests.conftest import TINY
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(TINY):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{TINY}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return v if v is None or isinstance(v, str) else int(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    return sorted((tuple(plain(r[j]) for j in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, TINY)
    found = df.collect()
    if name not in catalog.ORACLE_SQL:
        return
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, found) == rows(columns, cursor.fetchall())


def test_ranked_files_asks_for_every_part(spark, duck):
    found = catalog.QUERIES["ranked_files"](spark, TINY).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in found} == {k: 5 for (k,) in duck.execute("select distinct p_partkey from part").fetchall()}


def test_ranked_files_of_odd_parts(spark, tmp_path):
    con = duckdb.connect()
    con.execute("""create table part as select * from (values (1, 'large ring', 'SMALL'), (2, 'large ring', 'SMALL'), (3, 'Ring, LARGE', 'small'), (3, 'hot bolt', 'PROMO'), (4, null, 'PROMO'), (5, 'old rod', null),
      (6, '', ''), (7, 'ring ring rings', 'ringer'), (null, 'cold anvil', 'ECONOMY'), (9, 'cold anvil', 'economical'), (10, '!!', 'rod'), (11, 'reopened depot', 'interment'), (12, 'opened', 'pot'), (13, 'large ring', 'SMALL'),
      (14, 'ring large', 'small'), (15, 'large ring', 'SMALL'), (16, 'large ring', 'SMALL')) as x(p_partkey, p_name, p_type)""")
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    df = catalog.QUERIES["ranked_files"](spark, str(tmp_path))
    cursor = con.execute(catalog.ORACLE_SQL["ranked_files"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())
    con.execute("create or replace table part as from part limit 0")
    con.execute(f"copy part to '{tmp_path}/none.parquet' (format parquet)")
    (tmp_path / "empty").mkdir()
    (tmp_path / "none.parquet").rename(tmp_path / "empty" / "part.parquet")
    assert catalog.QUERIES["ranked_files"](spark, str(tmp_path / "empty")).collect() == []
