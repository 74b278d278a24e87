"""Causality-preserving edge reduction. Every mode takes and returns edges; vertices are never lost.

A merged edge keeps the id and start of its first edge, takes the end of its last and the sum of sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.graph import COLUMNS, SECOND
from tracelight.operators.dependence import preserving
from tracelight.plans.fixpoint import earlier


def windowed_sequence(edges: DataFrame, window: int) -> DataFrame:
    """Runs of one (event, src, dst) whose gaps are at most `window` become one edge: gaps and islands."""
    by = Window.partitionBy("event", "src", "dst").orderBy("start_t", "end_t", "edge_id")
    gap = F.col("start_t") - F.lag("end_t").over(by)
    runs = edges.withColumn("brk", F.when(gap > window, 1).otherwise(0)).withColumn("run", F.sum("brk").over(by))
    key = F.struct("start_t", "end_t", "edge_id")
    out = runs.groupBy("event", "src", "dst", "run").agg(
        F.min_by("edge_id", key).alias("edge_id"), F.min_by("etype", key).alias("etype"), F.min_by("start_t", key).alias("start_t"), F.max_by("end_t", key).alias("end_t"), F.sum("size").alias("size")
    )
    return out.select(*COLUMNS)


def full_merge(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst)."""
    key = F.struct("end_t", "edge_id")
    out = edges.groupBy("src", "dst").agg(
        F.min_by("edge_id", key).alias("edge_id"), F.min_by("etype", key).alias("etype"), F.min_by("start_t", key).alias("start_t"), F.max("end_t").alias("end_t"), F.sum("size").alias("size")
    )
    return out.withColumn("event", F.lit("NullAfterMerge")).select(*COLUMNS)


def _touch(edges: DataFrame, probes: DataFrame, node: str) -> DataFrame:
    """For probes (node, at, pid, own_s, own_e): how many of the node's edges are open at `at`, and the latest end before it.

    Starts, ends and probes of a node are one ordered sequence with running aggregates: no range join. An edge is open at
    `at` if it starts before and ends at or after it. A probe's own edge, where it lies at the node, is left out.
    """
    points = edges.select(F.col(node).alias("node"), F.col("start_t").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e"), F.lit(None).cast("long").alias("end_at"), F.lit(None).cast("long").alias("pid"))
    ends = edges.select(F.col(node).alias("node"), F.col("end_t").alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.col("end_t").alias("end_at"), F.lit(None).cast("long").alias("pid"))
    asked = probes.select("node", "at", F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(None).cast("long").alias("end_at"), "pid")
    run = earlier(points.unionAll(ends).unionAll(asked), ["node"], "at", {"n_open": F.sum(F.col("s") - F.col("e")), "last_end": F.max("end_at")})
    return run.where("pid is not null").select("pid", F.col("n_open").alias("open"), "last_end")


def standard_cpr(edges: DataFrame) -> DataFrame:
    """Merge neighbours of one (event, src, dst) unless another edge into src or out of dst touches the gap between them."""
    by = Window.partitionBy("event", "src", "dst").orderBy("start_t", "end_t", "edge_id")
    rows = edges.withColumn("prev_end", F.lag("end_t").over(by))
    back = _touch(edges, rows.select(F.col("src").alias("node"), F.col("end_t").alias("at"), F.col("edge_id").alias("pid")), "dst")
    fore = _touch(edges, rows.select(F.col("dst").alias("node"), F.col("start_t").alias("at"), F.col("edge_id").alias("pid")), "src")
    both = rows.join(back.select(F.col("pid").alias("edge_id"), F.col("open").alias("b_open"), F.col("last_end").alias("b_last")), "edge_id").join(
        fore.select(F.col("pid").alias("edge_id"), F.col("open").alias("f_open"), F.col("last_end").alias("f_last")), "edge_id"
    )
    # Self-loops lie at both nodes themselves: their own edge is open at its end, and never before its start.
    loop = F.col("src") == F.col("dst")
    own_open = F.when(loop & (F.col("start_t") < F.col("end_t")), 1).otherwise(0)
    back_hit = F.coalesce((F.col("prev_end") < F.col("end_t")) & ((F.col("b_open") - own_open > 0) | (F.col("b_last") > F.col("prev_end"))), F.lit(False))
    item = F.struct("start_t", "end_t", "edge_id", "etype", "size", back_hit.alias("hit"), (F.col("f_open") > 0).alias("f_open"), "f_last")
    groups = both.groupBy("event", "src", "dst").agg(F.array_sort(F.collect_list(item)).alias("items"))
    # The run at hand beside the finished ones, which only grow where a run ends.
    run = "struct<edge_id:bigint,etype:string,start_t:bigint,end_t:bigint,size:bigint>"

    def fold(acc, x):
        now = acc["now"]
        fore_hit = (now["start_t"] < x["start_t"]) & (x["f_open"] | F.coalesce(x["f_last"] > now["start_t"], F.lit(False)))
        merge = now.isNotNull() & F.coalesce(~x["hit"] & ~fore_hit, F.lit(False))
        grown = F.struct(now["edge_id"].alias("edge_id"), now["etype"].alias("etype"), now["start_t"].alias("start_t"), x["end_t"].alias("end_t"), (now["size"] + x["size"]).alias("size"))
        fresh = F.struct(x["edge_id"].alias("edge_id"), x["etype"].alias("etype"), x["start_t"].alias("start_t"), x["end_t"].alias("end_t"), x["size"].alias("size"))
        done = F.when(merge | now.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(now)))
        return F.struct(F.when(merge, grown).otherwise(fresh).cast(run).alias("now"), done.alias("done"))

    start = F.struct(F.lit(None).cast(run).alias("now"), F.array().cast(f"array<{run}>").alias("done"))
    folded = F.aggregate("items", start, fold, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    merged = groups.select("event", "src", "dst", F.explode(folded).alias("m"))
    return merged.select("event", "src", "dst", "m.*").select(*COLUMNS)


def reduced(edges: DataFrame, mode: str = "windowed_sequence", window: int = 10 * SECOND, fd_window: int = -1, sd_limit: int = -1) -> DataFrame:
    if mode == "windowed_sequence":
        return windowed_sequence(edges, window)
    if mode in ("standard_cpr", "causal_strict"):
        return standard_cpr(edges)
    if mode in ("full_merge", "endpoint_aggregation"):
        return full_merge(edges)
    if mode in ("fd", "sd"):
        return preserving(edges, mode == "sd", fd_window, sd_limit)
    if mode == "no_merge":
        return edges.select(*COLUMNS)
    raise ValueError(f"unknown reduction mode {mode!r}")
