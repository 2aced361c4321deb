"""Bars from a stream of trades or events: the one part of the engine that can run unbounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, width: str = "1 day", lateness: str = "1 hour", key: str = "asset_id", time: str = "ts", price: str = "price", size: str = "size") -> DataFrame:
    """(key, start, vwap, volume, n): tumbling bars of a batch or a stream. In a stream a bar is
    final once the watermark has passed its end, and later rows are dropped."""
    ticks = ticks.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a timestamp with a time zone
    rows = ticks.withWatermark(time, lateness) if ticks.isStreaming else ticks
    value = F.sum(F.col(price) * F.col(size))
    volume = F.sum(size)
    out = rows.groupBy(F.window(time, width).alias("bar"), key).agg((value / F.when(volume != 0, volume)).alias("vwap"), volume.alias("volume"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("bar.start").alias("start"), "vwap", "volume", "n")
