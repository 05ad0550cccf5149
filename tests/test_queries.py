"""All queries that have SQL give the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import decimal
import os

import pytest

import __spark_entry__
from tessera.plans import all_oracles, all_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_rows(spark, con, name):
    df = all_queries()[name](spark, DATA)
    want = con.execute(all_oracles()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in want.fetchall())


def test_entry(spark):
    assert set(__spark_entry__.queries()) >= set(all_queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
