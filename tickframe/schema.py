"""The bar contract: one long table of all symbols' bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
SESSIONS = ("pre", "rth", "post")
BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType(), False), T.StructField("ts", T.TimestampType(), False)]
    + [T.StructField(x, T.DoubleType()) for x in (*PRICES, "volume")]
    + [T.StructField("session", T.StringType())]
)


class BarError(ValueError):
    """Bars that break the contract."""


def normalised(bars: DataFrame) -> DataFrame:
    """Typed bars in which missing is NULL, never NaN; other columns stay."""
    typed = {f.name: F.col(f.name).cast(f.dataType) for f in BAR_SCHEMA if f.name in bars.columns}
    return bars.withColumns({k: F.nanvl(c, F.lit(None)) if k in (*PRICES, "volume") else c for k, c in typed.items()})


def violations(bars: DataFrame) -> DataFrame:
    """One row: how many bars break each rule. Keys that repeat are found by counts by (symbol, ts), partial in each task."""
    odd = ~F.col("session").isin(*SESSIONS)
    rows = bars.agg(
        F.count_if(F.col("symbol").isNull()).alias("no_symbol"),
        F.count_if(F.col("ts").isNull()).alias("no_ts"),
        F.count_if(F.col("close").isNull()).alias("no_close"),
        F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if(F.coalesce(odd, F.lit(True))).alias("unknown_session"),
    )
    again = bars.groupBy("symbol", "ts").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_key"))
    return rows.crossJoin(F.broadcast(again))  # one row each


def validate(bars: DataFrame) -> DataFrame:
    """bars, or BarError if columns are missing, have other types, or rows break a rule."""
    have = dict(bars.dtypes)
    for f in BAR_SCHEMA:
        if have.get(f.name) != f.dataType.simpleString():
            raise BarError(f"column {f.name}: {f.dataType.simpleString()} is needed, there is {have.get(f.name)}")
    broken = {k: n for k, n in violations(bars).first().asDict().items() if n}
    if broken:
        raise BarError(f"bars break the contract: {broken}")
    return bars
