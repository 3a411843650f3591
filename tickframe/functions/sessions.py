"""Trading sessions by wall clock, and completeness of the last bar."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..timeframe import Timeframe, eastern

OPEN_MINUTE, CLOSE_MINUTE = 9 * 60 + 30, 16 * 60


def session_of(ts: Column, timeframe: Timeframe) -> Column:
    """pre before 09:30 Eastern, rth before 16:00, else post; daily bars are rth."""
    if not timeframe.is_intraday:
        return F.lit("rth")
    minute = F.hour(eastern(ts)) * 60 + F.minute(eastern(ts))
    return F.when(minute < OPEN_MINUTE, "pre").when(minute < CLOSE_MINUTE, "rth").otherwise("post")


def tag_sessions(bars: DataFrame, timeframe: Timeframe) -> DataFrame:
    return bars.withColumn("session", session_of(F.col("ts"), timeframe))


def rth_only(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("session") == "rth")


def bar_end(ts: Column, timeframe: Timeframe) -> Column:
    """When a bar is complete. A daily one: 16:00 Eastern of its date; a label late in the Eastern evening (midnight UTC) means the next date."""
    if timeframe.is_intraday:
        return F.timestamp_seconds(F.unix_timestamp(ts) + timeframe.seconds)
    local = eastern(ts)
    day = F.date_trunc("day", local) + F.when(F.hour(local) >= 17, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    return F.to_utc_timestamp(day + F.expr("interval 16 hours"), "America/New_York")


def drop_incomplete(bars: DataFrame, timeframe: Timeframe, now: datetime | Column) -> DataFrame:
    """Without a symbol's last bar if it isn't complete at `now`; earlier bars are never tested."""
    now = now if isinstance(now, Column) else F.lit(now)
    last = F.lead("ts").over(Window.partitionBy("symbol").orderBy("ts")).isNull()
    return bars.withColumn("__last", last).filter(~(F.col("__last") & (bar_end(F.col("ts"), timeframe) > now))).drop("__last")


def session_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "session").agg(F.count("*").alias("n"))


def trim_delay(bars: DataFrame, timeframe: Timeframe, now: datetime, delay_seconds: int) -> DataFrame:
    """Bars that end at least delay_seconds before now."""
    return bars.filter(F.unix_timestamp("ts") + timeframe.seconds <= F.unix_timestamp(F.lit(now)) - delay_seconds)
