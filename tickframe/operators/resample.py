"""Higher timeframes: resampling, and values of closed buckets only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample_ohlcv(bars: DataFrame, bucket: Column) -> DataFrame:
    """One bar for each non-empty bucket; rth if any bar is rth, else the first one's session."""
    return (
        bars.withColumn("__b", bucket)
        .groupBy("symbol", F.col("__b").alias("bucket"))
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.when(F.bool_or(F.col("session") == "rth"), F.lit("rth")).otherwise(F.min_by("session", "ts")).alias("session"),
        )
    )


def closed_value(bars: DataFrame, bucket: Column, higher: DataFrame, *columns: str) -> DataFrame:
    """bars with the columns of the last closed bucket: each bar lies in a bucket of its own, so the backward as-of join is an equi-join
    with the bucket before. higher: symbol, bucket and the columns."""
    w = Window.partitionBy("symbol").orderBy("bucket")
    shifted = higher.select("symbol", "bucket", *(F.lag(c).over(w).alias(c) for c in columns))
    return bars.withColumn("bucket", bucket).join(shifted, ["symbol", "bucket"], "left").drop("bucket")


def dedup_keep_last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of rows with equal keys the last one by order; partial max_by in each task, no sort of all rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*rows.columns)


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol; all if n is 0."""
    if n <= 0:
        return bars
    number = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return bars.withColumn("__n", number).filter(F.col("__n") <= n).drop("__n")
