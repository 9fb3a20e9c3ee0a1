"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from workload import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_every_query_has_sql():
    assert set(load().QUERIES) == set(load().ORACLES)


@pytest.mark.parametrize("name", sorted(load().QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    places = [want.columns.index(c) for c in cols]
    canon = lambda rows: sorted(repr(r) for r in rows)
    assert canon(tuple(r[c] for c in cols) for r in df.collect()) == canon(tuple(r[i] for i in places) for r in want.fetchall())
