"""Flow: volume split by size into a large and a small side, their shares, biases, dominance flips and divergences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, compare, guarded_ratio, ladder, sure
from ..operators import window as w
from ..operators.recursive import Recursion, ema, exact_steps, with_recursions

PREFIX = "sf"


@dataclass(frozen=True)
class Flow:
    """The defaults."""

    gate_mode: str = "percentile"
    gate_len: int = 100
    retail_thr: float = 50.0
    inst_thr: float = 75.0
    soft_gate: bool = True
    weight_mode: str = "participation"
    scale_mode: str = "share"
    accum_len: int = 13
    smooth_len: int = 5
    double_smooth: bool = False
    div_len: int = 8
    low_vol_pct: float = 40.0
    active_vol_pct: float = 60.0
    bias_thr: float = 0.25
    edge_only: bool = True

    @property
    def warmup(self) -> int:
        return self.gate_len + max(self.accum_len, self.div_len) + self.smooth_len * (2 if self.double_smooth else 1)


def weighted(bars: DataFrame, c: Flow) -> DataFrame:
    """__dv, __pct, __clv and the sides' weights __iw, __rw."""
    bars = bars.withColumn("__dv", F.col("volume") * w.hlc3())
    dv = F.col("__dv")
    bars = bars.withColumns({"__earlier": w.before(dv, c.gate_len), "__prev": F.coalesce(w.lag(F.col("close")), F.col("close"))})
    bars = bars.withColumn("__pct", w.share_at_most(F.col("__earlier"), dv, c.gate_len)).drop("__earlier")
    if c.gate_mode == "percentile":
        gate = F.col("__pct")
    else:
        gate = guarded_ratio(dv - w.sma(dv, c.gate_len), w.stdev_pop(dv, c.gate_len), 0.0)
    bars = bars.withColumn("__gate", gate)
    gate, span = F.col("__gate"), c.inst_thr - c.retail_thr
    if c.soft_gate:
        large = clip((gate - c.retail_thr) / span, 0.0, 1.0) if span > 0 else sure(gate >= c.inst_thr).cast("double")
        small = 1.0 - large
    else:
        large, small = sure(gate >= c.inst_thr).cast("double"), sure(gate <= c.retail_thr).cast("double")
    close, hi, lo = F.col("close"), F.greatest("high", "__prev"), F.least("low", "__prev")
    return bars.withColumns({"__iw": large, "__rw": small, "__clv": F.when(hi - lo > 0, ((close - lo) - (hi - close)) / (hi - lo)).otherwise(0.0)})


def prepare(bars: DataFrame, c: Flow) -> DataFrame:
    """What comes before the recursions; of the helpers only what they and finish() read is left."""
    before = bars.columns
    bars = weighted(bars, c)
    dv, clv, close = F.col("__dv"), F.col("__clv"), F.col("close")
    side = {"i": dv * F.col("__iw"), "r": dv * F.col("__rw")}
    toward = F.lit(1.0) if c.weight_mode == "participation" else (clv + 1.0) / 2.0
    sums = {}
    for s, x in side.items():
        sums |= {f"__{s}_raw": w.rolling_sum(x * toward, c.accum_len), f"__{s}_gross": w.rolling_sum(x, c.accum_len), f"__{s}_net": w.rolling_sum(x * clv, c.accum_len)}
        sums |= {f"__{s}_fast_gross": w.rolling_sum(x, c.div_len), f"__{s}_fast_net": w.rolling_sum(x * clv, c.div_len)}
    bars = bars.withColumns(sums | {"sf_tape_pct": w.rolling_median(F.col("__pct"), c.div_len), "__move": w.change(close, c.div_len)})
    ratio = lambda s, k, top, other: guarded_ratio(top * F.col(f"__{s}_{k}net"), F.col(f"__{s}_{k}gross"), other)
    bars = bars.withColumns({"__r_signed": ratio("r", "", 100.0, 0.0), "__i_signed": ratio("i", "", 100.0, 0.0), "sf_inst_bias": ratio("i", "fast_", 1.0, 0.0), "sf_retail_bias": ratio("r", "fast_", 1.0, 0.0), "sf_inst_net_usd": F.col("__i_net")})
    if c.scale_mode == "share":
        r = guarded_ratio(100.0 * F.col("__r_raw"), F.col("__i_raw") + F.col("__r_raw"), 50.0)
        bars = bars.withColumn("__r", r).withColumn("__i", 100.0 - F.col("__r"))
    elif c.scale_mode == "signed":
        bars = bars.withColumns({"__r": F.col("__r_signed"), "__i": F.col("__i_signed")})
    else:
        bars = bars.withColumns({f"__{s}_e": w.before(F.col(f"__{s}_raw"), c.gate_len) for s in "ri"})
        bars = bars.withColumns({f"__{s}": w.share_at_most(F.col(f"__{s}_e"), F.col(f"__{s}_raw"), c.gate_len) for s in "ri"}).drop("__r_e", "__i_e")
    return bars.select(*before, "sf_tape_pct", "sf_inst_bias", "sf_retail_bias", "sf_inst_net_usd", "__r", "__i", "__r_signed", "__i_signed", "__move")


def recursions(c: Flow) -> tuple[list[Recursion], list[str]]:
    """The recursions, and the columns that they leave spent."""
    n, twice = c.smooth_len, c.double_smooth
    # The signed scales are never missing, nor are the two sides but for the independent scale, where each has gaps of its own.
    dense = None if c.scale_mode == "independent" else "__i_signed"
    # Ranks are shares of whole numbers: the two sides tie, and which is above then hangs on the last digit of every step.
    steps = exact_steps(2 / (n + 1)) if c.scale_mode == "independent" and n > 1 else 1
    lines = [ema("__r1" if twice else "sf_retail", "__r", n, gaps=dense, steps=steps), ema("__i1" if twice else "sf_inst", "__i", n, gaps=dense, steps=steps)]
    if twice:
        lines += [ema("sf_retail", "__r1", n, gaps=dense and "__r1", steps=steps), ema("sf_inst", "__i1", n, gaps=dense and "__r1", steps=steps)]
    return [*lines, ema("sf_inst_flow", "__i_signed", n), ema("sf_retail_flow", "__r_signed", n, gaps="__i_signed")], ["__r", "__i", "__r1", "__i1", "__r_signed", "__i_signed"]


def finish(bars: DataFrame, c: Flow) -> DataFrame:
    r, i = F.col("sf_retail"), F.col("sf_inst")
    quiet, active = sure(F.col("sf_tape_pct") <= c.low_vol_pct), sure(F.col("sf_tape_pct") >= c.active_vol_pct) if c.active_vol_pct > 0 else F.lit(True)
    ib, rb, move, t = F.col("sf_inst_bias"), F.col("sf_retail_bias"), F.col("__move"), c.bias_thr
    raw = {
        "sf_accum": sure(move < 0) & quiet & (ib >= t), "sf_dist": sure(move > 0) & quiet & (ib <= -t),
        "__bull": (ib >= t) & (rb >= t) & active, "__bear": (ib <= -t) & (rb <= -t) & active,
    }
    bars = bars.withColumns(raw | {"__over": w.crossover(r, i), "__under": w.crossunder(r, i), "__n": w.bar_number(), "sf_regime": compare(r, i)})
    edge = w.rising_edge if c.edge_only else sure
    bars = bars.withColumns({k: edge(F.col(k)) for k in raw} | {"sf_bars_since_flip": F.coalesce(w.bars_since(F.col("__over") | F.col("__under"), F.col("__n")), F.lit(0))})
    bars = bars.withColumns({"sf_flip": ladder((F.col("__over"), 1), (F.col("__under"), -1), otherwise=0), "sf_confluence": ladder((F.col("__bull"), 1), (F.col("__bear"), -1), otherwise=0)})
    return bars.drop("__move", "__bull", "__bear", "__over", "__under", "__n")


def flow(bars: DataFrame, c: Flow = Flow()) -> DataFrame:
    """bars with the sf_ columns."""
    specs, spent = recursions(c)
    return finish(with_recursions(prepare(bars, c), *specs, spent=spent), c)
