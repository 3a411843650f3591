"""Ordered window primitives by symbol. All use one partitioning and order, so Spark plans one exchange, one sort and one window node."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import sure


_partition: ContextVar[tuple[str, ...]] = ContextVar("partition", default=("symbol",))


@contextmanager
def partitioned_by(*columns: str) -> Iterator[None]:
    """Windows that are made within run over parts of symbols (see slices)."""
    token = _partition.set(columns)
    try:
        yield
    finally:
        _partition.reset(token)


def by_symbol() -> WindowSpec:
    return Window.partitionBy(*_partition.get()).orderBy("ts")


def last_rows(n: int) -> WindowSpec:
    """The current bar and the n - 1 before it."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def _full(value: Column, x: Column, n: int) -> Column:
    """value where the window holds n bars, none of them missing."""
    return F.when(F.count(x).over(last_rows(n)) == n, value)


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_symbol())


def change(x: Column, n: int = 1) -> Column:
    return x - lag(x, n)


def sma(x: Column, n: int) -> Column:
    return _full(F.avg(x).over(last_rows(n)), x, n)


def stdev_pop(x: Column, n: int) -> Column:
    return _full(F.stddev_pop(x).over(last_rows(n)), x, n)


def rolling_sum(x: Column, n: int) -> Column:
    return _full(F.sum(x).over(last_rows(n)), x, n)


def rolling_median(x: Column, n: int) -> Column:
    return _full(F.percentile(x, F.lit(0.5)).over(last_rows(n)), x, n)


def highest(x: Column, n: int) -> Column:
    return _full(F.max(x).over(last_rows(n)), x, n)


def lowest(x: Column, n: int) -> Column:
    return _full(F.min(x).over(last_rows(n)), x, n)


def before(x: Column, n: int) -> Column:
    """The n values before the current bar, in order; missing ones are left out."""
    return F.collect_list(x).over(by_symbol().rowsBetween(-n, -1))


def share_at_most(values: Column, x: Column, n: int) -> Column:
    """Percentage of the n earlier values that are at most x; needs all n. values comes from before()."""
    return F.when((F.size(values) == n) & x.isNotNull(), F.size(F.filter(values, lambda v: v <= x)) * F.lit(100.0) / n)


def percent_rank(x: Column, n: int) -> Column:
    """Percentage of the n values before this bar's that are at most as great."""
    return share_at_most(before(x, n), x, n)


def ffill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def crossover(a: Column, b: Column, b_before: Column | None = None) -> Column:
    """a rises above b. For a constant b, give it as b_before too."""
    return sure((a > b) & (lag(a) <= (lag(b) if b_before is None else b_before)))


def crossunder(a: Column, b: Column, b_before: Column | None = None) -> Column:
    return sure((a < b) & (lag(a) >= (lag(b) if b_before is None else b_before)))


def rising_edge(condition: Column) -> Column:
    return sure(condition) & ~sure(lag(sure(condition)))


def bar_number() -> Column:
    return F.row_number().over(by_symbol())


def bars_since(condition: Column, number: Column) -> Column:
    """Bars since the condition last held; NULL before it first did. number: bar_number() as a column."""
    return number - ffill(F.when(condition, number))


def true_range() -> Column:
    """The first bar's is high - low: greatest() leaves the missing previous close out."""
    h, low, prev = F.col("high"), F.col("low"), lag(F.col("close"))
    return F.greatest(h - low, F.abs(h - prev), F.abs(low - prev))


def hlc3() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3
