"""Market overview of a scan's rows: one aggregation, a top five, the starred symbols, the index tape, and a short history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, sure

HISTORY = 12
#: The share of symbols that makes a market regime.
MAJORITY = 55.0


def overview(rows: DataFrame) -> DataFrame:
    """One row. Missing values count as not above zero, but in the denominator."""
    share = lambda c: F.avg(sure(c).cast("double")) * 100.0
    out = rows.agg(
        F.count("*").alias("universe"),
        F.count_if(F.col("day_chg") > 0).alias("advancers"), F.count_if(F.col("day_chg") < 0).alias("decliners"), F.count_if("new_high").alias("new_highs"),
        share(F.col("above_sma50")).alias("above_sma50_pct"), share(F.col("ggr_state") > 0).alias("pct_bull"), share(F.col("ggr_state") < 0).alias("pct_bear"),
        F.median(clip(50.0 + F.col("mb_score"), 0.0, 100.0)).alias("iron"), share(F.col("mb_score") > 0).alias("pct_positive"),
        F.sum(F.coalesce("sf_inst_net_usd", F.lit(0.0))).alias("silver_net"), share(F.col("sf_inst_bias") > 0).alias("pct_inflow"),
    )
    return out.withColumn("regime", F.when(F.col("pct_bull") >= MAJORITY, "RISK-ON").when(F.col("pct_bear") >= MAJORITY, "RISK-OFF").otherwise("NEUTRAL"))


def top_signals(rows: DataFrame, n: int = 5) -> DataFrame:
    columns = ("symbol", "day_chg", "composite", "signal", "mb_state", "ggr_state", "sf_regime")
    return rows.orderBy(F.col("composite").desc_nulls_last(), "symbol").limit(n).select(*columns)


def starred(stars: DataFrame, rows: DataFrame) -> DataFrame:
    """Every starred symbol with its row, if it has one."""
    return stars.join(rows, "symbol", "left")


def tape(daily: DataFrame, labels: DataFrame) -> DataFrame:
    """symbol, label, last, chg_pct of each labelled symbol; a single bar has no change. Only labelled symbols' bars are ordered."""
    daily = daily.join(labels.select("symbol").distinct(), "symbol", "left_semi")
    w = Window.partitionBy("symbol").orderBy("ts")
    last = F.lead("ts").over(w).isNull()
    bars = daily.withColumns({"prev": F.coalesce(F.lag("close").over(w), F.col("close")), "__last": last}).filter("__last")
    chg = F.when(F.col("prev") != 0, (F.col("close") / F.col("prev") - 1) * 100.0).otherwise(0.0)
    return labels.join(bars, "symbol").select("symbol", "label", F.col("close").alias("last"), chg.alias("chg_pct"))


def push_history(history: list[dict], point: dict) -> list[dict]:
    """The last HISTORY points with the new one."""
    return [*history, point][-HISTORY:]
