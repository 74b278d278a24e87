"""The contract between sources, operators and plans.

An edge frame has edge_id, src, dst, etype, event, start_t, end_t and size; weighted ones also w_time, w_amount, w_struct
and weight. Times are whole nanoseconds. src and dst are nodes: a kind (P process, F file, N network), a colon and the
signature, so that a file and a process of one signature are two nodes, whatever the signature begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000_000
KINDS = ("P", "N", "F")
COLUMNS = ["edge_id", "src", "dst", "etype", "event", "start_t", "end_t", "size"]
SCHEMA = "edge_id long, src string, dst string, etype string, event string, start_t long, end_t long, size long"


def node(kind: str | Column, signature: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), signature)


def kind(node: str | Column) -> Column:
    return F.substring(node, 1, 1)


def signature(node: str | Column) -> Column:
    return F.substring(F.col(node) if isinstance(node, str) else node, 3, 1 << 30)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def resolved(edges: DataFrame, names: list[str]) -> list[str]:
    """The nodes of a graph that names mean: nodes as they are, or signatures of any kind; in the order of names."""
    wanted = sorted({n for n in names if n})
    if not wanted:
        return []
    found = nodes_of(edges).where(F.col("node").isin(wanted) | signature("node").isin(wanted)).collect()  # a few for each name
    have = {r["node"] for r in found}
    out = []
    for n in names:
        out += [n] if n in have else [k for k in (f"{kind_}:{n}" for kind_ in KINDS) if k in have]
    return list(dict.fromkeys(out))
