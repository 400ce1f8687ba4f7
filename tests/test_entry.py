"""The driver's contract, and every catalog query against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from codeweft.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark, duck):
    assert __spark_entry__.entry(spark).columns[0] == "id"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    rel = duck.sql(catalog.ORACLES[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall())))
