"""Momentum: a squashed, smoothed ratio, its state ladder, relative volume and stars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import guarded_ratio, ladder, sure
from ..operators import window as w
from ..operators.recursive import Recursion, ema, with_recursions

PREFIX = "mb"


@dataclass(frozen=True)
class Momentum:
    """The defaults."""

    mode: str = "velocity"
    mom_len: int = 10
    bench_len: int = 50
    sensitivity: float = 2.0
    smooth_len: int = 3
    deadband: float = 5.0
    strong_lvl: float = 30.0
    rvol_len: int = 20
    rvol_trigger: float = 2.0
    rvol_rth_only: bool = True
    stars_fresh_only: bool = False

    @property
    def warmup(self) -> int:
        return self.bench_len + self.mom_len + self.smooth_len + self.rvol_len


def prepare(bars: DataFrame, c: Momentum) -> DataFrame:
    """What comes before the recursion. In warm-up the raw ratio is 0, so the score is seeded with zeros."""
    close, volume = F.col("close"), F.col("volume")
    if c.mode == "velocity":
        bars = bars.withColumn("__m", w.change(close, c.mom_len))
        raw = guarded_ratio(F.col("__m"), w.sma(F.abs("__m"), c.bench_len), 0.0)
    else:
        bars = bars.withColumn("__m", close - w.sma(close, c.bench_len))
        raw = guarded_ratio(F.col("__m"), w.stdev_pop(close, c.bench_len), 0.0)
    rth = sure(F.col("session") == "rth")
    if c.rvol_rth_only:
        # The average runs over regular bars only: a window of their own, carried on over the others.
        own = Window.partitionBy("symbol", rth).orderBy("ts").rowsBetween(-(c.rvol_len - 1), 0)
        bars = bars.withColumn("__avg", F.when(rth & (F.count("volume").over(own) == c.rvol_len), F.avg("volume").over(own)))
        bars = bars.withColumn("__avg", w.ffill(F.col("__avg")))
    else:
        bars = bars.withColumn("__avg", w.sma(volume, c.rvol_len))
    return bars.withColumn("mb_raw", raw).withColumn("__s", F.lit(50.0) * F.tanh(F.col("mb_raw") / c.sensitivity)).drop("__m")


def recursions(c: Momentum) -> tuple[list[Recursion], list[str]]:
    """The recursions, and the columns that they leave spent."""
    return [ema("mb_score", "__s", c.smooth_len)], ["__s"]


def finish(bars: DataFrame, c: Momentum) -> DataFrame:
    volume, rth = F.col("volume"), sure(F.col("session") == "rth")
    score, strong = F.col("mb_score"), max(c.strong_lvl, c.deadband)
    bars = bars.withColumns(
        {
            "mb_state": ladder((score >= strong, 2), (score > c.deadband, 1), (score <= -strong, -2), (score < -c.deadband, -1), otherwise=0),
            "mb_strength_pct": F.abs(score) / 50.0 * 100.0,
            "mb_rvol": guarded_ratio(volume, F.col("__avg"), None),
        }
    )
    surge = sure(F.col("mb_rvol") >= c.rvol_trigger) & (rth if c.rvol_rth_only else F.lit(True))
    up, down = (F.col("mb_state") > 0) & surge, (F.col("mb_state") < 0) & surge
    if c.stars_fresh_only:
        up, down = w.rising_edge(up), w.rising_edge(down)
    zero, hi, lo = F.lit(0.0), F.lit(strong), F.lit(-strong)
    return bars.withColumns(
        {
            "mb_star": ladder((up, 1), (down, -1), otherwise=0),
            "mb_cross_zero_up": w.crossover(score, zero, zero),
            "mb_cross_zero_dn": w.crossunder(score, zero, zero),
            "mb_cross_strong_up": w.crossover(score, hi, hi),
            "mb_cross_strong_dn": w.crossunder(score, lo, lo),
        }
    ).drop("__avg")


def momentum(bars: DataFrame, c: Momentum = Momentum()) -> DataFrame:
    """bars with the mb_ columns."""
    specs, spent = recursions(c)
    return finish(with_recursions(prepare(bars, c), *specs, spent=spent), c)
