"""Streaming forms of batch operators; on finite input their output equals the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_rates(events: DataFrame, keys, ts: str, width: str, lateness: str) -> DataFrame:
    """Counts per key and tumbling window; rows later than ``lateness`` are dropped by the watermark."""
    return events.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, width).alias("_w")).agg(
        F.count(F.lit(1)).alias("n")).select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), "n")


def islands(events: DataFrame, keys, ts: str, max_gap: str, lateness: str) -> DataFrame:
    """Gaps-and-islands as session windows: an island closes ``max_gap`` after its last event."""
    w = F.session_window(ts, max_gap)
    return events.withWatermark(ts, lateness).groupBy(*keys, w.alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("stop")).select(*keys, "start", "stop", "n")
