"""Registered queries and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelight.plans import testgraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False, graph: bool = True):
    """Registers a query, with SQL over the test graph (or over the tables alone)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = ("WITH " + "RECURSIVE " * recursive + testgraph.SQL + "\n" + sql) if graph else sql
        return f

    return add
