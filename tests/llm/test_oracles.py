"""Queries with SQL against DuckDB over whole tables."""

import glob
import os

import duckdb
import pytest

from tracelight.llm import oracles, queries

DATA = "/root/testdata/sf0.01"


def rows(columns, found):
    return sorted(repr(tuple(int(x) if isinstance(x, bool) else x for x in r)) for r in found)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"select {','.join(columns)} from ({oracles.SQL[name]})")
    assert sorted(c[0] for c in want.description) == columns
    assert rows(columns, df.select(*columns).collect()) == rows(columns, want.fetchall())
