"""Fixpoint iteration over distributed frames, and helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

def _folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share."""
    _folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new path in that folder, without the scheme of a local one."""
    return f"{_folder(spark).removeprefix('file:')}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as columns in that folder: a reader of some of them reads no others, and they take a fraction of a checkpoint's disk.

    The folder is deleted when the driver ends, since frames that read it can outlive any call.
    """
    spark, to = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(to)
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(to)


def released(df: DataFrame) -> None:
    """Delete what stored() wrote for df, once no frame reads it any more, and let Spark delete the shuffles that made it: its
    cleaner waits for the driver's collector, which a driver with little to do seldom runs."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    df.sparkSession._jvm.System.gc()


def held(df: DataFrame) -> bool:
    """Whether df is only read (a checkpoint, a table), so that reading it again computes nothing again."""
    return df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() in ("LogicalRDD", "LogicalRelation")


#: Rows of a frame (counted first) that are sent to every task rather than shuffling what they are joined to.
BROADCAST_ROWS = 250_000


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Rows a shuffle partition (counted first) of what a hash table is made of rather than sorting both sides of a join.
HASHED_ROWS = 2_000_000


def hashed(df: DataFrame, n: int) -> DataFrame:
    """df, of at most n rows, to be joined by a hash table a partition where that is small; else, or where it is unknown, sorted."""
    return df.hint("shuffle_hash") if n <= HASHED_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], keep: str | None = None, least: bool = False, max_rounds: int | None = None) -> DataFrame:
    """Delta iteration: step(frontier) makes candidate rows, of which those that improve on the state are the next frontier.

    keep: the column of which the state holds each key's greatest (or least) value; without it rows are keys alone. A round
    is one job that aggregates the state and the candidates by key, so that the state stays partitioned by it, and counts
    on the way how many rows are new. A small frontier is broadcast, so that the rows it meets stay where they are.
    """
    of, columns = (F.min if least else F.max), [*keys, *([keep] if keep else [])]

    def best(df: DataFrame) -> DataFrame:
        return df.groupBy(keys).agg(of(keep).alias(keep)) if keep else df.select(*keys).distinct()

    state = checkpoint(best(state.select(*columns)))
    frontier, rounds = small(state, state.count()), 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        both = state.withColumn("_old", F.lit(True)).unionByName(step(frontier).select(*columns).withColumn("_old", F.lit(False)))
        if keep:
            merged = both.groupBy(keys).agg(of(keep).alias(keep), of(F.when(F.col("_old"), F.col(keep))).alias("_had"))
            fresh = ~F.col("_had").eqNullSafe(F.col(keep))
        else:
            merged, fresh = both.groupBy(keys).agg(F.max("_old").alias("_had")), ~F.col("_had")
        seen = Observation()
        merged = checkpoint(merged.observe(seen, F.count(F.when(fresh, 1)).alias("n")))
        n = seen.get["n"]
        state, frontier = merged.select(*columns), small(merged.where(fresh).select(*columns), n)
        if not n:
            break
    return state


def settled(state: DataFrame, step: Callable[[DataFrame], DataFrame], order: list[str]) -> DataFrame:
    """The state that step() maps to itself, for steps whose rows depend on earlier ones only: step() until nothing changes."""
    mark, seen = [F.count("*").alias("n"), F.sum(F.xxhash64(*order).cast("decimal(38,0)")).alias("x")], None
    while True:
        now = Observation()
        state = checkpoint(state.observe(now, *mark))
        if now.get == seen:
            return state
        seen, state = now.get, step(state)


#: Spans into which the order of a running aggregate is cut.
SPANS = 64


def earlier(rows: DataFrame, keys: list[str], at: str, aggregates: dict[str, Column], spans: int = SPANS) -> DataFrame:
    """rows with aggregates over the earlier rows of the same key, by column at: sums where the name begins with n_, else maxima.

    The range of `at` is cut into spans: what the spans before a row's own give comes from partial aggregates, the rest
    from a window over its own span. So a key with many rows is one task a span, not one task.
    """
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return rows.withColumns({n: F.lit(None).cast("long") for n in aggregates})
    width = max(1, -(-(high - low + 1) // spans))
    cut = rows.withColumn("_span", F.floor((F.col(at) - low) / F.lit(width)))
    per = cut.groupBy(*keys, "_span").agg(*[a.alias(f"_{n}") for n, a in aggregates.items()])
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    merge = {n: (F.sum if n.startswith("n_") else F.max)(f"_{n}").over(before) for n in aggregates}
    carried = per.select(*keys, "_span", *[m.alias(f"_{n}") for n, m in merge.items()])
    within = Window.partitionBy(*keys, "_span").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *[a.over(within).alias(f"_own_{n}") for n, a in aggregates.items()])
    joined = own.join(carried, [*keys, "_span"])
    total = lambda n: (F.coalesce(f"_{n}", F.lit(0)) + F.coalesce(f"_own_{n}", F.lit(0))) if n.startswith("n_") else F.greatest(f"_{n}", f"_own_{n}")
    return joined.select(*rows.columns, *[total(n).alias(n) for n in aggregates])


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 in a total order: range partitions are numbered apart and shifted by the counts before them."""
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").count()
    before = counts.withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    shifted = parts.withColumn("_rank", within).join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    return shifted.withColumn(name, F.col("_before") + F.col("_rank")).drop("_part", "_before", "_rank")


def codes(nodes: DataFrame) -> DataFrame:
    """node, code: the nodes (distinct) numbered from 0 in the order of their names."""
    return checkpoint(ranked(nodes.select("node"), ["node"], "code").select("node", (F.col("code") - 1).cast("int").alias("code")))


def coded(rows: DataFrame, names: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """rows with the codes s and d of two columns of nodes."""
    code = lambda c, to: names.select(F.col("node").alias(c), F.col("code").alias(to))
    return rows.join(code(src, "s"), src).join(code(dst, "d"), dst)


def in_one_task(rows: DataFrame, order: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over all rows in order, in one task of an executor: for work that is one sequence, over numbers only."""
    return rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, schema)


def filled(batches: Iterator[pa.RecordBatch], n: int, kinds: list) -> list[np.ndarray]:
    """The first columns of n rows as arrays, filled batch by batch, so that nothing is held twice."""
    out, at = [np.empty(n, k) for k in kinds], 0
    for b in batches:
        for i, a in enumerate(out):
            a[at : at + len(b)] = b.column(i).to_numpy(zero_copy_only=False)
        at += len(b)
    return out


def numbered_ends(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], pa.Array, list[pa.RecordBatch]]:
    """The first two columns of batches (names) as numbers in the order of the names, the names, and the other columns."""
    sides, rest, at = ([], []), [], {}
    for b in batches:
        for i, side in enumerate(sides):
            told = b.column(i).dictionary_encode()
            own = np.fromiter((at.setdefault(v, len(at)) for v in told.dictionary.to_pylist()), np.int32, len(told.dictionary))
            side.append(own[told.indices.to_numpy(zero_copy_only=False)])
        rest.append(b.select(b.schema.names[2:]))
    names = pa.array(list(at), pa.string())
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return [rank[np.concatenate(side)] if side else np.zeros(0, np.int32) for side in sides], names.take(pa.array(order)), rest


def least_linked(s: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Of each of n numbered nodes the smallest that undirected links reach."""
    label = np.arange(n, dtype=np.int32)
    while len(s):
        a, b = label[s], label[d]
        apart = a != b
        s, d, a, b = s[apart], d[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


#: Pairs that components() links in one task, where it may.
IN_PROCESS = 10_000_000


def _components_in_one_task(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (s, d), names, _ = numbered_ends(batches)
        label = least_linked(s, d, len(names))
        for lo in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([names[lo : lo + 100_000], names.take(pa.array(label[lo : lo + 100_000]))], ["node", "component"])

    return pairs.repartition(1).mapInArrow(run, "node string, component string")


def linked_numbers(links: DataFrame, n: int, in_process: int = IN_PROCESS) -> DataFrame:
    """s, component: of each of n nodes numbered from 0 the smallest number that undirected links (s, d) reach.

    At most in_process links (counted first) are followed in one task, which is given numbers only.
    """
    many = links.count()
    if many > in_process:
        return checkpoint(components(links, "s", "d").select(F.col("node").alias("s"), "component"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = least_linked(*filled(batches, many, [np.int32, np.int32]), n)
        for lo in range(0, n, 100_000):
            some = label[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(some), dtype=np.int32)), pa.array(some)], ["s", "component"])

    return checkpoint(links.select("s", "d").repartition(1).mapInArrow(run, "s int, component int"))


def components(pairs: DataFrame, a: str = "src", b: str = "dst", in_process: int = 0) -> DataFrame:
    """node, component: the smallest node that undirected links reach.

    Large-star and small-star steps in turn: the rounds grow with the logarithm of the diameter. A node that many links meet
    is pre-aggregated; its join is skewed, which adaptive execution splits. At most in_process pairs of names (counted
    first) are linked in one task instead.
    """
    every = checkpoint(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    if in_process and every.count() <= in_process:
        return _components_in_one_task(every)
    e = every.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark, seen = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")], None
    while True:
        now = Observation()
        e = checkpoint(e.observe(now, *mark))
        if now.get == seen or not now.get["n"]:
            break
        seen = now.get
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpoint(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
    nodes = every.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
