"""Seeded recursions (EMA, Wilder's RMA, RSI, ATR) along a symbol's bars, as window expressions.

y = alpha * x + (1 - alpha) * y before it. Values are cut into blocks by their number in the series. Within a block y is a running sum of inputs with
growing weights, scaled back; what came before the block is an affine map's other half: the value at the end of the block before, times a power of
1 - alpha. A block is so long that what came before the block before it weighs less than a double's last digit, so that one carry is enough, and no longer. Everything is a window over one exchange by symbol: nothing is stepped value by value, and no Python runs.

Seeding: the first value is the mean of the first n valid inputs, none before. A missing input is skipped (on_gap="skip": the recursion goes
on over the valid ones) or starts the seeding again (on_gap="reset").
"""

from __future__ import annotations

import math
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import window as w


@dataclass(frozen=True)
class Recursion:
    """gaps: a column that is missing where the source is (the source itself if none is named); recursions with the same gaps share their numbering,
    and so their window nodes. steps: how many of the last steps are taken as the definition says, see exact_steps."""

    out: str
    source: str
    n: int
    alpha: float
    on_gap: str = "skip"
    gaps: str | None = None
    steps: int = 1


def ema(out: str, source: str, n: int, on_gap: str = "skip", gaps: str | None = None, steps: int = 1) -> Recursion:
    return Recursion(out, source, n, 2 / (n + 1), on_gap, gaps, steps)


def rma(out: str, source: str, n: int, on_gap: str = "skip", gaps: str | None = None) -> Recursion:
    return Recursion(out, source, n, 1 / n, on_gap, gaps)


#: What came before the block before may weigh e^-LEAST of a value at most: less than a double's last digit.
LEAST = 41.5


def exact_steps(alpha: float) -> int:
    """So many last steps by definition that a difference of a last digit at their start is rounded away, as a rule. Where two recursions over whole
    numbers are compared, their ties then fall as they do step by step."""
    return math.ceil(24 / -math.log1p(-alpha))


def block_length(alpha: float) -> int:
    """The shortest power of two that is long enough: sums are short, and weights stay below e^(2 * LEAST)."""
    return 1 << max(1, math.ceil(math.log2(LEAST / -math.log1p(-alpha))))


def block_lengths(alphas: set[float]) -> dict[float, int]:
    """A block length for each alpha below 1; a shorter one's where it is long enough and its weights don't overflow."""
    out: dict[float, int] = {}
    for alpha in sorted((a for a in alphas if a < 1), reverse=True):
        rate = -math.log1p(-alpha)
        fits = [n for n in out.values() if LEAST <= n * rate <= 300]
        out[alpha] = min(fits) if fits else block_length(alpha)
    return out


#: Weights of a whole series' running sum stay below e^MOST.
MOST = 400.0


def unbroken(s: Recursion, longest: int | None) -> bool:
    """Whether a series of at most `longest` bars needs no blocks: its weights don't overflow. It is summed by symbol then, without sorts of its own."""
    return longest is not None and s.on_gap == "skip" and s.alpha < 1 and longest * -math.log1p(-s.alpha) <= MOST


def with_recursions(bars: DataFrame, *specs: Recursion, spent: Collection[str] = (), longest: int | None = None) -> DataFrame:
    """bars with each recursion's column, without those that are spent then; a recursion may read another's output that stands before it.
    longest: no symbol has more bars."""
    names, left = bars.columns, list(specs)
    while left:
        outputs = {s.out for s in left}
        ready = [s for s in left if s.source not in outputs]
        bars = _side_by_side(bars, ready, longest)
        left = [s for s in left if s.source in outputs]
    return bars.select(*(c for c in (*names, *(s.out for s in specs)) if c not in spent))


def _step(alpha: float) -> Callable[[Column, Column], Column]:
    return lambda y, t: alpha * t["x"] + (1 - alpha) * y


def _equal(name: str, value: Column) -> Callable[[Column], Column]:
    return lambda t: t[name] == value


def _side_by_side(bars: DataFrame, specs: list[Recursion], longest: int | None = None) -> DataFrame:
    """Recursions of which none reads another's output; those of one source share its numbering, those of one block length its blocks."""
    before = bars.columns
    every = w.by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    key = lambda s: (s.gaps or s.source, s.on_gap)
    kinds = {k: i for i, k in enumerate(dict.fromkeys(map(key, specs)))}
    whole = {s.out for s in specs if unbroken(s, longest)}
    lengths = {k: block_lengths({s.alpha for s in specs if key(s) == k and s.out not in whole}) for k in kinds}
    where = lambda s: kinds[key(s)]
    length = lambda s: lengths[key(s)][s.alpha]
    cut = [s for s in specs if s.alpha < 1]
    numbers = {f"__v{k}": F.count(gaps).over(every) - 1 for (gaps, on_gap), k in kinds.items() if on_gap == "skip"}
    if any(on_gap == "reset" for _, on_gap in kinds):
        numbers["__row"] = F.row_number().over(w.by_symbol())
    seeds = {f"__seed{i}": F.avg(s.source).over(every if s.on_gap == "skip" else w.last_rows(s.n)) for i, s in enumerate(specs)}
    bars = bars.withColumns(numbers | seeds)
    if "__row" in numbers:
        # __run: the row of the last missing input; the value's number counts from there.
        last = lambda gaps: F.last(F.when(F.col(gaps).isNull(), F.col("__row")), ignorenulls=True).over(every)
        runs = {f"__run{k}": F.coalesce(last(gaps), F.lit(0)) for (gaps, on_gap), k in kinds.items() if on_gap == "reset"}
        bars = bars.withColumns(runs)
        bars = bars.withColumns({f"__v{k[5:]}": F.col("__row") - F.col(k) - 1 for k in runs})
    cuts = sorted({(where(s), length(s)) for s in cut if s.out not in whole})
    bars = bars.withColumns({f"__b{k}_{n}": F.floor(F.col(f"__v{k}") / n) for k, n in cuts}) if cuts else bars

    def place(s: Recursion) -> tuple[Column, Column, Column]:
        """The value's number, its place in its block, and whether it is there and past the seed."""
        v = F.col(f"__v{where(s)}")
        return v, v if s.out in whole else F.pmod(v, F.lit(length(s))), F.col(s.source).isNotNull() & (v >= s.n - 1)

    scaled = {}
    # Divided by the same powers that scale back: what is left of their rounding doesn't grow with the exponent.
    for i, s in enumerate(specs):
        if s in cut:
            v, at, there = place(s)
            k = where(s)
            own = w.by_symbol()
            if s.out not in whole:
                own = Window.partitionBy("symbol", *([f"__run{k}"] if s.on_gap == "reset" else []), f"__b{k}_{length(s)}").orderBy("ts")
            x = F.when(v == s.n - 1, F.col(f"__seed{i}")).otherwise(s.alpha * F.col(s.source))
            total = F.sum(F.when(there, x / F.pow(F.lit(1 - s.alpha), at))).over(own.rowsBetween(Window.unboundedPreceding, 0))
            scaled[f"__z{i}"] = total * F.pow(F.lit(1 - s.alpha), at)
    if whole:
        bars = bars.withColumns({f"__z{i}": scaled[f"__z{i}"] for i, s in enumerate(specs) if s.out in whole})
    # A window node for each blocking of each source: the same ones side by side.
    for own in cuts:
        bars = bars.withColumns({f"__z{i}": scaled[f"__z{i}"] for i, s in enumerate(specs) if s in cut and s.out not in whole and (where(s), length(s)) == own})
    ends = {}
    for i, s in enumerate(specs):
        if s in cut and s.out not in whole:
            _, at, there = place(s)
            run = F.col(f"__run{where(s)}") if s.on_gap == "reset" else F.lit(0)
            end = F.when(there & (at == length(s) - 1), F.struct(F.col(f"__z{i}").alias("z"), run.alias("run")))
            ends[f"__end{i}"] = F.last(end, ignorenulls=True).over(w.by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    bars = bars.withColumns(ends) if ends else bars
    out = {}
    for i, s in enumerate(specs):
        if s in cut:
            v, at, there = place(s)
            if s.out in whole:
                out[s.out] = F.when(there, F.when(v == s.n - 1, F.col(f"__seed{i}")).otherwise(F.col(f"__z{i}")))
                continue
            end = F.col(f"__end{i}")
            same = end["run"] == (F.col(f"__run{where(s)}") if s.on_gap == "reset" else F.lit(0))
            carried = F.when(same, end["z"] * F.pow(F.lit(1 - s.alpha), at + 1)).otherwise(F.lit(0.0))
            out[s.out] = F.when(there, F.when(v == s.n - 1, F.col(f"__seed{i}")).otherwise(F.col(f"__z{i}") + carried))
        else:
            out[s.out] = F.col(s.source)
    bars = bars.withColumns(out)
    # The last step is taken as the definition says, from the value before: rounding is that of one step, not of powers and sums.
    last = {}
    for s in cut:
        v, _, there = place(s)
        was = F.last(s.out, ignorenulls=True).over(w.by_symbol().rowsBetween(Window.unboundedPreceding, -1))
        last[s.out] = F.when(there & (v > s.n - 1), s.alpha * F.col(s.source) + (1 - s.alpha) * was).otherwise(F.col(s.out))
    bars = bars.withColumns(last)
    # More of the last steps, folded over the values of so many rows.
    folded = {}
    for s in cut:
        if s.steps > 1:
            v, _, there = place(s)
            value = F.when(there, F.struct(F.col(s.source).alias("x"), F.col(s.out).alias("y")))
            if s.on_gap == "reset":
                value = F.when(there, F.struct(F.col(s.source).alias("x"), F.col(s.out).alias("y"), F.col(f"__run{where(s)}").alias("run")))
            folded[s] = f"__steps{len(folded)}", F.collect_list(value).over(w.by_symbol().rowsBetween(-s.steps, 0))
    bars = bars.withColumns(dict(folded.values())) if folded else bars
    last = {}
    for s, (name, _) in folded.items():
        v, _, there = place(s)
        own = F.col(name) if s.on_gap == "skip" else F.filter(name, _equal("run", F.col(f"__run{where(s)}")))
        y = F.aggregate(F.slice(own, 2, s.steps), own[0]["y"], _step(s.alpha))
        last[s.out] = F.when(there & (F.size(own) > 2), y).otherwise(F.col(s.out))
    return (bars.withColumns(last) if last else bars).select(*before, *out)


def with_rsi(bars: DataFrame, out: str, source: str, n: int) -> DataFrame:
    """RSI: the undefined first change isn't part of the seed; without losses it is 100."""
    d = w.change(F.col(source))
    bars = bars.withColumn("__d", d)
    bars = bars.withColumns({"__gain": F.greatest(F.col("__d"), F.lit(0.0)), "__loss": F.greatest(-F.col("__d"), F.lit(0.0))})
    bars = bars.withColumns({c: F.when(F.col("__d").isNotNull(), F.col(c)) for c in ("__gain", "__loss")})
    bars = with_recursions(bars, rma("__up", "__gain", n, gaps="__d"), rma("__down", "__loss", n, gaps="__d"))
    return rsi_column(bars, out).drop("__d", "__gain", "__loss")


def rsi_column(bars: DataFrame, out: str) -> DataFrame:
    up, down = F.col("__up"), F.col("__down")
    value = F.when(down == 0, 100.0).when(down.isNotNull(), 100.0 - 100.0 / (1.0 + up / down))
    return bars.withColumn(out, value).drop("__up", "__down")


def with_atr(bars: DataFrame, out: str, n: int) -> DataFrame:
    return with_recursions(bars.withColumn("__tr", w.true_range()), rma(out, "__tr", n)).drop("__tr")
