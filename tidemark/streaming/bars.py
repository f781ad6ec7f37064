"""Bars from a stream of ticks, by event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of ticks (symbol, ts, value); ticks later than ``lateness`` are left out.

    The state is one row for each symbol and open window. Works on a batch as well, where nothing is late.
    """
    rows = ticks.select("symbol", F.col("ts").cast("timestamp").alias("event_time"), "value").withWatermark("event_time", lateness)
    out = rows.groupBy(F.window("event_time", width), "symbol").agg(
        F.min_by("value", "event_time").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_time").alias("close"), F.count("*").cast("double").alias("volume"),
    )
    return out.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
