"""Streams: the batch operators over events as they come, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, session_start, session_end, n and value: sessions that a pause of ``gap`` ends; events later than ``late`` are dropped with their state."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "value")


def consistency_stream(facts: DataFrame, keys: list[str], value: str, ts: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """keys, window_start, low, high and n_facts of windows whose facts state more than one value."""
    out = facts.withWatermark(ts, late).groupBy(*keys, F.window(ts, window).alias("w")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n_facts"))
    return out.where("low < high").select(*keys, F.col("w.start").alias("window_start"), "low", "high", "n_facts")
