"""K2: counters and latency histograms per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logsift import constants as C


def windowed_counters(
    decisions: DataFrame, time: str = "created_at", width: str = "1 hour", late: str = "1 hour"
) -> DataFrame:
    """Requests by window, source and recommendation; works on streams and on tables.

    On a stream, rows later than the watermark are dropped and a window is emitted once
    it can no longer change.
    """
    return (
        decisions.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), "source", "recommendation")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("w.start").alias("window_start"), "source", "recommendation", "requests")
    )


def windowed_latency(
    latencies: DataFrame, time: str = "created_at", width: str = "1 hour", late: str = "1 hour",
    column: str = "seconds",
) -> DataFrame:
    """Cumulative latency buckets per window, one column per upper bound."""
    names = [f"le_{b:g}".replace(".", "_") for b in C.LATENCY_BUCKETS]
    return (
        latencies.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"))
        .agg(*[F.sum((F.col(column) <= b).cast("int")).alias(n)
               for n, b in zip(names, C.LATENCY_BUCKETS)],
             F.count(F.lit(1)).alias("le_inf"))
        .select(F.col("w.start").alias("window_start"), *names, "le_inf")
    )
