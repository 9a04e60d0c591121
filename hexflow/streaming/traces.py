"""Extension: counts of observed visits over event time, from a stream of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(traces: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Visits per window and kind; on a stream, rows later than ``late`` are dropped."""
    ts = traces.withColumn("ts", F.col("ts").cast("timestamp"))
    if traces.isStreaming:
        ts = ts.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ts.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def sessions(traces: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits per user and session."""
    ts = traces.withColumn("ts", F.col("ts").cast("timestamp"))
    if traces.isStreaming:
        ts = ts.withWatermark("ts", late)
    out = ts.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
