"""Bars from trade-like tables. Every symbol's bars come from one aggregation, partial in each task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sessions import tag_sessions
from ..operators.slices import SLICE, slice_of
from ..timeframe import Timeframe, bucket


def in_order(*keys: tuple[Column, int]) -> Column:
    """Keys (value, digits), the first the most important, as one number: min_by and max_by over numbers stay in a hash aggregation, over structs
    they would sort all rows."""
    out, below = None, 0
    for value, digits in reversed(keys):
        part = value.cast(f"decimal({digits},0)") * F.lit(10**below).cast(f"decimal({below + 1},0)") if below else value.cast(f"decimal({digits},0)")
        out, below = part if out is None else part + out, below + digits
    return out


#: Rows of the table for each partition of symbols, about.
ROWS_A_TASK = 250_000


def by_symbol(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows by symbol in as many partitions as so many need, where the session's number is too small: the aggregation and every sort of the later
    windows hold a partition in a task, so that its memory stays the same however many symbols there are. All of them then share this exchange."""
    n = math.ceil(n_rows / ROWS_A_TASK)
    return rows.repartition(n, "symbol") if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _ohlcv(rows: DataFrame, volume, *within: str) -> DataFrame:
    return rows.groupBy("symbol", *within, "ts").agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"),
        volume.cast("double").alias("volume"),
    )


def _priced(table: DataFrame) -> DataFrame:
    return table.select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", in_order((F.col("l_orderkey"), 15), (F.col("l_linenumber"), 3), (F.col("l_partkey"), 13)).alias("k"),
    )


def daily_from_lineitem(spark: SparkSession, sf_dir: str, whole_symbols: bool = True) -> DataFrame:
    """A symbol for each supplier, a bar for each ship date; price: extended price over quantity. whole_symbols: in partitions for windows by symbol."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = _priced(table)
    return tag_sessions(_ohlcv(by_symbol(rows, table.count()) if whole_symbols else rows, F.sum("l_quantity")), Timeframe.D1)


def daily_in_slices(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    """The bars of daily_from_lineitem with their slice of so many seconds, dealt by symbol and slice: the aggregation and all that runs within slices
    share this one exchange."""
    rows = _priced(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).withColumn(SLICE, slice_of(F.col("ts"), seconds))
    return tag_sessions(_ohlcv(rows.repartition("symbol", SLICE), F.sum("l_quantity"), SLICE), Timeframe.D1)


def from_events(spark: SparkSession, sf_dir: str, timeframe: Timeframe = Timeframe.H1) -> DataFrame:
    """A symbol for each event type, bars of the timeframe; price: value, volume: number of events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"), bucket(F.col("ts").cast("timestamp"), timeframe.seconds).alias("ts"), F.col("value").alias("price"),
        in_order((F.unix_micros(F.col("ts").cast("timestamp")), 18), (F.col("event_id"), 15)).alias("k"),
    )
    return tag_sessions(_ohlcv(rows, F.count("*")), timeframe)
