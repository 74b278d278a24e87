"""Aggregates over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight import graph


def detection_size(edges: DataFrame, poi: str) -> DataFrame:
    """The largest size of an edge into the point of interest, else out of it."""
    at = edges.where((F.col("dst") == poi) | (F.col("src") == poi))
    sizes = at.agg(F.max(F.when(F.col("dst") == poi, F.col("size"))).alias("i"), F.max(F.when(F.col("src") == poi, F.col("size"))).alias("o"))
    return sizes.select(F.when(F.col("i") > 0, F.col("i")).otherwise(F.coalesce("o", F.lit(0))).cast("long").alias("detection_size"))


def poi_time(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max("end_t").alias("poi_time"))


def latest_operation(edges: DataFrame, poi: str) -> DataFrame:
    """The latest end, and the latest start, of the edges into the point of interest."""
    return edges.where(F.col("dst") == poi).agg(F.max("end_t").alias("latest_end"), F.max("start_t").alias("latest_start"))


def source_sums(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("size").alias("size_sum"), F.count("*").alias("n"))


def moments(edges: DataFrame, column: str) -> DataFrame:
    """Mean, sample deviation, least, greatest and second least value."""
    least = edges.agg(F.min(column).alias("least"))
    second = edges.crossJoin(F.broadcast(least)).where(F.col(column) > F.col("least")).agg(F.min(column).alias("second_least"))  # one row
    return edges.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("deviation"), F.min(column).alias("least"), F.max(column).alias("greatest")).crossJoin(second)  # single rows


def pair_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def kind_event_counts(edges: DataFrame) -> DataFrame:
    kinds = graph.nodes_of(edges).groupBy(graph.kind("node").alias("name")).agg(F.count("*").alias("n"))
    return kinds.select(F.lit("kind").alias("what"), "name", "n").unionAll(edges.groupBy(F.col("event").alias("name")).agg(F.count("*").alias("n")).select(F.lit("event"), "name", "n"))


def weight_bins(edges: DataFrame, column: str = "weight") -> DataFrame:
    """Ten bins from 0.0 to 0.9; what lies outside goes to the first or last."""
    tenth = F.greatest(F.least(F.floor(F.col(column) * 10), F.lit(9)), F.lit(0))
    return edges.groupBy(tenth.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def compression(before: DataFrame, after: DataFrame) -> DataFrame:
    """Numbers of edges before and after and their ratio to four places."""
    out = before.agg(F.count("*").alias("edges_before")).crossJoin(after.agg(F.count("*").alias("edges_after")))  # single rows
    return out.withColumn("ratio", F.round(F.col("edges_before") / F.col("edges_after"), 4))


def time_index(events: DataFrame, file: str, at: str) -> DataFrame:
    """Least and greatest time and number of events of each file."""
    return events.groupBy(F.col(file).alias("file")).agg(F.min(at).alias("least"), F.max(at).alias("greatest"), F.count("*").alias("n_events"))


def overlapping(index: DataFrame, start: int, end: int) -> DataFrame:
    """Files that can hold events of the window; those without events go."""
    return index.where(F.col("n_events").isNull() | ((F.col("n_events") > 0) & (F.col("greatest") >= start) & (F.col("least") <= end)))
