"""Bars from an event stream: closed ones only.

Events are grouped into buckets under a watermark; append mode gives a bucket out once the watermark has passed its end, so that no bar
changes after it was given (non-repainting). State is one row for each open bucket of a symbol, whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, length: str = "1 hour", delay: str = "15 minutes", offset: str = "0 minutes") -> DataFrame:
    """events: symbol, ts, price, volume, id (breaks ties of ts), a stream or not. Bars with the bucket's start as ts."""
    k = F.struct("ts", "id")
    out = (
        events.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", length, length, offset).alias("w"))
        .agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.sum("volume").alias("volume"))
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def run_scans(bars: DataFrame, each, checkpoint: str, interval: str = "60 seconds"):
    """Calls each(batch of closed bars, batch id) for every batch: the rescan loop as a query that survives its driver."""
    return bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(each).start()
