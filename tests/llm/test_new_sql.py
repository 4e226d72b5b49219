"""The SQL of the newest operators gives their rows."""

import glob
import os

import duckdb
import pytest

from lanewise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_rank_convergence", "op13_reduced_alphabet"])
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    at = [theirs.columns.index(c) for c in ours.columns]
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(repr(tuple(row[i] for i in at)) for row in theirs.fetchall())
