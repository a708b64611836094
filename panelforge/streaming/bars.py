"""Bars from a stream of events: event time, a watermark for late rows, tumbling windows; the batch form gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_bars(events: DataFrame, length: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """symbol, start, open, high, low, close, volume; works on a stream (append mode) and on a table."""
    price, at = F.lit(100.0) + F.col("value"), F.struct("ts", "event_id")
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    keyed = rows.select("ts", F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"), price.alias("price"), at.alias("at"))
    out = keyed.groupBy(F.window("ts", length).alias("w"), "symbol").agg(F.min_by("price", "at").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "at").alias("c"), F.count(F.lit(1)).alias("v"))
    return out.select("symbol", F.col("w.start").alias("start"), "o", "h", "l", "c", "v")


def write_bars(events: DataFrame, path: str, checkpoint: str, length: str = "2 hours"):
    """Starts a query that writes finished bars as Parquet and ends when all present input is read."""
    return window_bars(events, length).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
