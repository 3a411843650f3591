"""Regime: moving-average direction, RSI band and thrust on the chart or on closed higher-timeframe bars, with an ATR width gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import compare, guarded_ratio, sure
from ..operators import window as w
from ..operators.recursive import Recursion, rma, rsi_column, with_recursions, with_rsi
from ..operators.resample import closed_value
from ..timeframe import Timeframe, eastern, session_bucket

PREFIX = "ggr"


@dataclass(frozen=True)
class Regime:
    """The defaults."""

    fast_len: int = 8
    slow_len: int = 20
    atr_len: int = 14
    rsi_len: int = 14
    band_len: int = 20
    band_mult: float = 1.0
    rsi_htf: Timeframe | None = None
    width_thresh: float = 0.5
    use_rsi_tier: bool = True
    use_thrust_tier: bool = True

    @property
    def warmup(self) -> int:
        return max(self.slow_len, self.rsi_len + self.band_len + 1, self.atr_len) + 5


def htf_bucket(timeframe: Timeframe):
    if not timeframe.is_intraday:
        return F.date_trunc("day", eastern(F.col("ts")))
    return session_bucket(F.col("ts"), timeframe.seconds, F.col("__first"))


def closed_rsi(bars: DataFrame, c: Regime) -> DataFrame:
    """rsi, its basis and deviation of the last closed higher bar, on each bar."""
    bars = bars.withColumn("__first", F.min("ts").over(Window.partitionBy("symbol")))
    bucket = htf_bucket(c.rsi_htf)
    higher = bars.withColumn("bucket", bucket).groupBy("symbol", "bucket").agg(F.max_by("close", "ts").alias("close")).filter("close is not null")
    higher = with_rsi(higher.withColumnRenamed("bucket", "ts"), "ggr_rsi", "close", c.rsi_len)
    rsi = F.col("ggr_rsi")
    higher = higher.withColumns({"ggr_rsi_basis": w.sma(rsi, c.band_len), "__dev": w.stdev_pop(rsi, c.band_len)}).withColumnRenamed("ts", "bucket")
    return closed_value(bars, bucket, higher.drop("close"), "ggr_rsi", "ggr_rsi_basis", "__dev").drop("__first")


def prepare(bars: DataFrame, c: Regime) -> DataFrame:
    """What comes before the recursions."""
    bars = bars.withColumn("__tr", w.true_range())
    if c.rsi_htf is not None:
        return bars
    d = w.change(F.col("close"))
    return bars.withColumns({"__gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "__loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})


def recursions(c: Regime) -> tuple[list[Recursion], list[str]]:
    """The recursions, and the columns that they leave spent."""
    own = [] if c.rsi_htf else [rma("__up", "__gain", c.rsi_len, gaps="__gain"), rma("__down", "__loss", c.rsi_len, gaps="__gain")]
    return [rma("__atr", "__tr", c.atr_len), *own], ["__tr", "__gain", "__loss"]


def finish(bars: DataFrame, c: Regime) -> DataFrame:
    close = F.col("close")
    if c.rsi_htf is None:
        bars = rsi_column(bars, "ggr_rsi")
        bars = bars.withColumns({"ggr_rsi_basis": w.sma(F.col("ggr_rsi"), c.band_len), "__dev": w.stdev_pop(F.col("ggr_rsi"), c.band_len)})
    else:
        bars = closed_rsi(bars, c)
    bars = bars.withColumns({"__fast": w.sma(close, c.fast_len), "__slow": w.sma(close, c.slow_len)})
    rsi, basis, dev = F.col("ggr_rsi"), F.col("ggr_rsi_basis"), F.col("__dev") * c.band_mult
    upper = F.when(dev.isNotNull(), F.least(F.lit(100.0), basis + dev))
    lower = F.when(dev.isNotNull(), F.greatest(F.lit(0.0), basis - dev))
    bars = bars.withColumns({"__upper": upper, "__lower": lower})
    fast, slow = F.col("__fast"), F.col("__slow")
    bars = bars.withColumns(
        {
            "__ma": compare(fast, slow),
            "__rs": compare(rsi, basis),
            "ggr_thrust": F.when(rsi > F.col("__upper"), 1).when(rsi < F.col("__lower"), -1).otherwise(0),
            "ggr_width_atr": guarded_ratio(fast - slow, F.col("__atr"), None),
            "ggr_rsi_band_width": F.col("__upper") - F.col("__lower"),
        }
    )
    ma = F.col("__ma")
    wide = sure(F.abs("ggr_width_atr") >= c.width_thresh) if c.width_thresh > 0 else F.lit(True)
    directional = (ma != 0) & wide
    thrust = directional & (F.col("ggr_thrust") == ma) if c.use_thrust_tier else F.lit(False)
    strong = directional & (F.col("__rs") == ma) if c.use_rsi_tier else F.lit(False)
    bars = bars.withColumns(
        {
            "ggr_state": ma * F.when(thrust, 3).when(strong, 2).when(directional, 1).otherwise(0),
            "ggr_ma_rsi_agree": (ma == F.col("__rs")).cast("int"),
            "ggr_cross_up": w.crossover(fast, slow),
            "ggr_cross_dn": w.crossunder(fast, slow),
        }
    )
    state, was = F.col("ggr_state"), F.lag("ggr_state", 1, 0).over(w.by_symbol())
    flipped = F.coalesce(F.signum(state) != F.signum(w.lag(state)), F.lit(True))  # the first bar is a flip
    bars = bars.withColumns({"__flip": flipped, "__n": w.bar_number(), "__was": was})
    was = F.col("__was")
    return bars.withColumns(
        {
            "ggr_bars_since_flip": w.bars_since(F.col("__flip"), F.col("__n")),
            "ggr_strong_up_enter": (state >= 2) & (was < 2),
            "ggr_strong_dn_enter": (state <= -2) & (was > -2),
            "ggr_thrust_up_enter": (state == 3) & (was != 3),
            "ggr_thrust_dn_enter": (state == -3) & (was != -3),
        }
    ).drop("__atr", "__dev", "__fast", "__slow", "__upper", "__lower", "__ma", "__rs", "__flip", "__n", "__was")


def regime(bars: DataFrame, c: Regime = Regime()) -> DataFrame:
    """bars with the ggr_ columns. Both recursions, Wilder's range and RSI, share one grouped pass."""
    specs, spent = recursions(c)
    return finish(with_recursions(prepare(bars, c), *specs, spent=spent), c)
