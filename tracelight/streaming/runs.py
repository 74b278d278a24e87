"""The windowed edge reduction over a stream: sessions of one (event, src, dst) with a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_runs(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of events (ts, event, src, dst, size); a run closes when the watermark passes its last event by the gap."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "event", "src", "dst")
        .agg(F.min("ts").alias("start_t"), F.max("ts").alias("end_t"), F.sum("size").alias("size"), F.count("*").alias("n"))
        .drop("session_window")
    )
