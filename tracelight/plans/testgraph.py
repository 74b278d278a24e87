"""A temporal multigraph over the star-schema tables, for queries that need a graph and have no system log at hand.

lineitem joined to orders gives reads (part to order) and writes (order to part), orders give receives (customer to order).
Nodes and times are as tracelight.graph has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight import graph
from tracelight.plans.fixpoint import ranked

#: The same graph in DuckDB's SQL.
SQL = """edges AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY src, dst, start_t, end_t, event, size) AS edge_id, * FROM (
    SELECT src, dst, min(etype) AS etype, min(event) AS event, start_t, end_t, min(size) AS size FROM (
      SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'F:part#' || l_partkey ELSE 'P:order#' || l_orderkey END AS src,
             CASE WHEN l_linenumber % 2 = 1 THEN 'P:order#' || l_orderkey ELSE 'F:part#' || l_partkey END AS dst,
             CASE WHEN l_linenumber % 2 = 1 THEN 'FtoP' ELSE 'PtoF' END AS etype,
             CASE WHEN l_linenumber % 2 = 1 THEN 'read' ELSE 'write' END AS event,
             1000 * least(epoch_us(o_orderdate), epoch_us(l_shipdate)) AS start_t,
             1000 * greatest(epoch_us(o_orderdate), epoch_us(l_shipdate)) AS end_t,
             CAST(l_quantity AS BIGINT) AS size
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      UNION ALL
      SELECT 'N:cust#' || o_custkey, 'P:order#' || o_orderkey, 'NtoP', 'recv', 1000 * epoch_us(o_orderdate), 1000 * epoch_us(o_orderdate),
             CAST(round(o_totalprice) AS BIGINT) FROM orders)
    GROUP BY src, dst, start_t, end_t)),
poi AS (SELECT dst AS poi FROM edges WHERE dst LIKE 'F:%' ORDER BY end_t DESC, dst LIMIT 1)"""


def nanos(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


#: Kinds of edges, in the order of the names of their types and of their events.
READ, RECEIVE, WRITE = range(3)


def deduplicated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, etype, event, start_t, end_t, size: one edge for each (source, target, start, end), as graph assembly keeps it.

    Each edge has an order at one end. So lines, and orders as lines of their customers, meet the times of orders in one
    shuffle over numbers, where equal edges meet too; names are made of what is left. Orders are never broadcast: their file
    is a small part of what they take in memory.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", nanos("o_orderdate").alias("o_t"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey IS NOT NULL")
    moved = items.select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("other"), F.when(F.col("l_linenumber") % 2 == 1, READ).otherwise(WRITE).alias("kind"), nanos("l_shipdate").alias("t"), F.col("l_quantity").cast("long").alias("size"))
    received = orders.select("o_orderkey", "o_custkey", F.lit(RECEIVE), "o_t", F.round("o_totalprice").cast("long"))
    of = orders.select("o_orderkey", "o_t").hint("merge")
    is_received = F.col("kind") == RECEIVE
    met = moved.unionAll(received).join(of, F.col("order") == F.col("o_orderkey"), "left").where(is_received | F.col("o_orderkey").isNotNull())
    time = lambda f: F.when(is_received, F.col("t")).otherwise(f("o_t", "t"))
    ends = F.when(is_received & F.col("other").isNull(), READ).otherwise(F.col("kind"))  # both come from nowhere
    met = met.select("order", "other", ends.alias("ends"), time(F.least).alias("start_t"), time(F.greatest).alias("end_t"), "kind", "size")
    kept = met.groupBy("order", "other", "ends", "start_t", "end_t").agg(F.min("kind").alias("kind"), F.min("size").alias("size"))
    part, customer, order = (F.concat(F.lit(name), c) for name, c in (("F:part#", "other"), ("N:cust#", "other"), ("P:order#", "order")))
    told = lambda *of_kinds: F.element_at(F.array(*of_kinds), F.col("kind") + 1)
    write = F.col("kind") == WRITE
    return kept.select(
        F.when(write, order).when(F.col("kind") == READ, part).otherwise(customer).alias("src"),
        F.when(write, part).otherwise(order).alias("dst"),
        told(*map(F.lit, ("FtoP", "NtoP", "PtoF"))).alias("etype"),
        told(*map(F.lit, ("read", "recv", "write"))).alias("event"),
        "start_t",
        "end_t",
        "size",
    )


def numbered(edges: DataFrame) -> DataFrame:
    """edge_id 1..n over the graph's natural order, without one task sorting all rows: ranks within ranges plus offsets."""
    return ranked(edges, ["src", "dst", "start_t", "end_t", "event", "size"], "edge_id")


def edges(spark: SparkSession, sf_dir: str, ids: bool = False) -> DataFrame:
    out = deduplicated_edges(spark, sf_dir)
    return numbered(out) if ids else out.withColumn("edge_id", F.xxhash64("src", "dst", "start_t", "end_t"))


def point_of_interest(edges: DataFrame) -> str:
    """The file whose last write ends latest."""
    return edges.where(graph.kind("dst") == "F").orderBy(F.desc("end_t"), "dst").select("dst").first()[0]
