"""Every query of the engine with SQL equals DuckDB over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from lanewise.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = duck.sql(ORACLES[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    want = sorted(repr([plain(row[i]) for i in at]) for row in theirs.fetchall())
    got = sorted(repr([plain(row[c]) for c in columns]) for row in ours.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
