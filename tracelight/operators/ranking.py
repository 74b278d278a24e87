"""Reputation propagation, entry candidates, rankings and graph filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracelight import graph
from tracelight.graph import nodes_of
from tracelight.operators.weights import degrees
from tracelight.plans.fixpoint import checkpoint, coded, codes, filled, in_one_task


def initial_reputation(edges: DataFrame, high: list[str], low: list[str], default: float = 0.0) -> DataFrame:
    """node, reputation: 1 for high, 0 for low and for nodes without in-edges, else the default."""
    d = degrees(edges)
    return d.select("node", F.when(F.col("node").isin(high), 1.0).when(F.col("node").isin(low) | (F.col("n_in") == 0), 0.0).otherwise(default).alias("reputation"))


#: Pairs up to which propagate() runs in one task (24 bytes each), unless told otherwise; rounds of it that are one job beyond.
IN_PROCESS, TOGETHER = 10_000_000, 4


def propagate(edges: DataFrame, reputation: DataFrame, fixed: list[str], tol: float = 1e-5, max_rounds: int = 3000, in_process: int = IN_PROCESS) -> DataFrame:
    """node, reputation after synchronous rounds rep(v) = sum of rep(target) * weight over out-edges; no damping.

    Rounds go on until all reputations together move by less than tol: often a thousand of them, each of which is little
    work. A graph of at most in_process pairs of nodes (counted first) is therefore iterated in one task over numbered nodes, a larger one by
    jobs of TOGETHER rounds, of which the first that moves by less than tol counts; results agree but for rounding. Parallel
    edges add up first. Nodes without out-edges become 0 unless fixed.
    """
    pairs = edges.where("weight <> 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    pairs = checkpoint(pairs.where(~F.col("src").isin(list(fixed))).select("src", F.col("dst").alias("node"), "weight").repartition("node"))
    n = pairs.count()
    if n <= in_process:
        return _propagated_here(pairs, n, reputation, fixed, tol, max_rounds)
    rep = checkpoint(reputation.select("node", "reputation"))
    held = checkpoint(rep.where(F.col("node").isin(list(fixed))))
    live, done = rep.where("reputation <> 0"), 0
    while done < max_rounds:
        k, rounds = min(TOGETHER, max_rounds - done), [live]
        for _ in range(k):
            told = pairs.join(rounds[-1], "node").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("reputation")).alias("reputation"))
            rounds.append(told.unionByName(held))
        tagged = [r.select("node", F.lit(i).alias("i"), "reputation") for i, r in enumerate(rounds)]
        wide = reduce(DataFrame.unionAll, tagged).groupBy("node").agg(*[F.coalesce(F.sum(F.when(F.col("i") == i, F.col("reputation"))), F.lit(0.0)).alias(f"r{i}") for i in range(k + 1)])
        moved = Observation()
        wide = checkpoint(wide.observe(moved, *[F.sum(F.abs(F.col(f"r{i + 1}") - F.col(f"r{i}"))).alias(f"m{i + 1}") for i in range(k)]))
        last = next((i for i in range(1, k + 1) if (moved.get[f"m{i}"] or 0.0) < tol), None)
        live, done = wide.select("node", F.col(f"r{last or k}").alias("reputation")).where("reputation <> 0"), done + k
        if last:
            break
    return rep.select("node").join(live, "node", "left").select("node", F.coalesce("reputation", F.lit(0.0)).alias("reputation"))


def _propagated_here(pairs: DataFrame, n: int, reputation: DataFrame, fixed: list[str], tol: float, max_rounds: int) -> DataFrame:
    ends = pairs.select(F.explode(F.array("src", "node")).alias("node")).distinct()
    names = codes(ends.unionByName(reputation.select("node")).distinct())
    given = names.join(reputation, "node").select("code", "reputation", F.col("node").isin(list(fixed)).alias("held"))
    n_nodes, n_given = names.count(), given.count()
    # Reputations come first (d = -1, or -2 where held), then the pairs by source.
    rows = given.select(F.col("code").alias("s"), F.when(F.col("held"), -2).otherwise(-1).alias("d"), F.col("reputation").alias("w"), F.lit(0).alias("pair"))
    rows = rows.unionByName(coded(pairs, names, "src", "node").select("s", "d", F.col("weight").alias("w"), F.lit(1).alias("pair")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, d, w = filled(batches, n_given + n, [np.int32, np.int32, np.float64])
        told, held, first = s[:n_given].copy(), s[:n_given][d[:n_given] == -2], np.zeros(n_nodes)
        first[told] = w[:n_given]
        s, d, w, live = s[n_given:], d[n_given:], w[n_given:], first != 0
        while True:  # pairs that lead to nothing but zeros are left out
            count = int(live.sum())
            live[s[live[d]]] = True
            if int(live.sum()) == count:
                break
        s, d, w = (x[live[d]] for x in (s, d, w)) if not live.all() else (s, d, w)
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        source, rep, product, new = s[at], first.copy(), np.empty(len(s)), np.zeros(n_nodes)
        for _ in range(max_rounds):
            new[:] = 0
            if len(at):
                np.take(rep, d, out=product, mode="clip")
                np.multiply(product, w, out=product)
                new[source] = np.add.reduceat(product, at)
            new[held] = first[held]
            rep -= new
            moved = np.abs(rep, out=rep).sum()
            rep, new = new, rep
            if moved < tol:
                break
        for lo in range(0, n_given, 100_000):
            some = told[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rep[some])], ["code", "reputation"])

    return names.join(checkpoint(in_one_task(rows, ["pair", "s", "d"], run, "code int, reputation double")), "code").select("node", "reputation")


def entry_candidates(edges: DataFrame, poi: str, libraries: list[str] = ()) -> DataFrame:
    """node, kind: all N; P that no N or P leads to; F that nothing leads to and that are no known libraries; never poi."""
    nodes = nodes_of(edges).where(F.col("node") != poi).withColumn("kind", graph.kind("node"))
    fed = edges.where(graph.kind("src").isin("N", "P")).select(F.col("dst").alias("node")).distinct()
    entered = edges.select(F.col("dst").alias("node")).distinct()
    network = nodes.where("kind = 'N'")
    process = nodes.where("kind = 'P'").join(fed, "node", "left_anti")
    file = nodes.where("kind = 'F'").where(~(F.col("node").isin(list(libraries)) | graph.signature("node").isin(list(libraries)))).join(entered, "node", "left_anti")
    return network.unionAll(process).unionAll(file)


def ranked_candidates(candidates: DataFrame, reputation: DataFrame) -> DataFrame:
    """node, kind, reputation, rank within the kind: by reputation, then by name."""
    order = Window.partitionBy("kind").orderBy(F.desc("reputation"), "node")
    return candidates.join(reputation, "node", "left").withColumn("reputation", F.coalesce("reputation", F.lit(0.0))).withColumn("rank", F.row_number().over(order))


def top_candidates(candidates: DataFrame, reputation: DataFrame, k: int = 3) -> DataFrame:
    """The best k of each kind; Spark limits each kind before its shuffle."""
    return ranked_candidates(candidates, reputation).where(F.col("rank") <= k)


def highlighted(configured: list[str], top: DataFrame) -> list[str]:
    rows = top.orderBy("kind", "rank").select("node").collect()  # a few of each kind
    return list(dict.fromkeys([c.strip() for c in configured if c.strip()] + [r[0] for r in rows]))


def random_starts(nodes: DataFrame, n: int, seed: int = 1, by_kind: bool = True) -> DataFrame:
    order = [F.xxhash64(F.lit(seed), "node"), F.col("node")]
    if not by_kind:
        return nodes.select("node").orderBy(*order).limit(n)
    kinds = nodes.select("node", graph.kind("node").alias("kind"))
    return kinds.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("rank") <= n).select("node")


def edges_of(edges: DataFrame, node: str) -> DataFrame:
    """side and edge of each edge at a node; heaviest first when collected in order of rank."""
    both = edges.where(F.col("dst") == node).withColumn("side", F.lit("in")).unionByName(edges.where(F.col("src") == node).withColumn("side", F.lit("out")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("weight"), "edge_id")))


def without_light_edges(edges: DataFrame) -> DataFrame:
    """Edges of at least a hundredth of the mean weight."""
    mean = edges.agg(F.avg("weight").alias("mean"))
    return edges.crossJoin(F.broadcast(mean)).where(F.col("weight") >= F.col("mean") / 100).drop("mean")  # one row


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge touches."""
    return nodes.join(nodes_of(edges), "node", "left_semi")


def without_unreputed(edges: DataFrame, reputation: DataFrame) -> DataFrame:
    """Edges between nodes whose reputation is not 0."""
    live = reputation.where("reputation <> 0").select("node")
    return edges.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def read_only_stats(edges: DataFrame) -> DataFrame:
    """Counts before and after files that nothing enters, and their edges, are dropped."""
    entered = edges.select(F.col("dst").alias("src")).distinct()
    plain = edges.where(graph.kind("src") == "F").join(entered, "src", "left_anti").select("src").distinct()
    rest = edges.join(plain, "src", "left_anti")
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(edges, "edges_before").crossJoin(count(rest, "edges_after")).crossJoin(count(nodes_of(edges), "nodes_before")).crossJoin(count(plain, "files_dropped"))  # single rows
