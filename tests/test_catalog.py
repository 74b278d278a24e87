"""Every query with an oracle against DuckDB, the others for rows, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from tracelight import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert got == sorted(map(repr, duck.execute(f"select {','.join(columns)} from ({sql})").fetchall()))
    else:
        assert got
