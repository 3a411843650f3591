"""Long symbols in several tasks: windows, carries and recursions over slices of time.

A slice is a stretch of time of one symbol. Windows that reach a bounded number of bars back run within (symbol, slice), where each slice repeats
the last bars before it as a halo, as many as the windows reach. What reaches back without bound is carried: each slice is reduced to a few numbers
(bars, valid inputs, the last value, an affine map), a pass over the slices of a symbol, far fewer than its bars, composes them, and every slice
takes up from what came before it by an equi-join.

So no task holds more of a symbol than a slice and its halo, and one symbol is spread over as many tasks as it has slices. Use it where symbols have
very many bars: it costs exchanges that windows by symbol don't.

Bars of a symbol have different times. seconds: the length of a slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import window as w
from .recursive import Recursion, block_length

SLICE = "__slice"
KEY = ("symbol", SLICE)


def slice_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds)


def with_slices(bars: DataFrame, seconds: int) -> DataFrame:
    """bars with their slice; those that came with one (of so many seconds) keep it, and so the partitions by it."""
    return bars if SLICE in bars.columns else bars.withColumn(SLICE, slice_of(F.col("ts"), seconds))


def _earlier(total: Column) -> Column:
    """The sum over a symbol's slices before this one."""
    before = Window.partitionBy("symbol").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(before), F.lit(0))


def with_halo(bars: DataFrame, seconds: int, reach: int) -> DataFrame:
    """bars with their slice, each slice with the `reach` bars before it (fewer if there aren't as many), which have __halo set."""
    bars = bars.drop(SLICE)
    rows = with_slices(bars, seconds)
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("__size"))
    sizes = sizes.withColumn("__upto", _earlier(F.col("__size")) + F.col("__size"))
    # The slices after this one whose halo reaches into it, with the bars that lie between: each slice between has one bar at least.
    later = F.collect_list(F.struct(F.col(SLICE).alias("to"), (F.col("__upto") - F.col("__size")).alias("before")))
    later = later.over(Window.partitionBy("symbol").orderBy(SLICE).rowsBetween(1, max(1, reach)))
    sizes = sizes.withColumn("__later", later)
    reached = F.filter("__later", lambda x: x["before"] - F.col("__upto") < reach)
    sizes = sizes.select(*KEY, F.transform(reached, lambda x: F.struct(x["to"].alias("to"), (x["before"] - F.col("__upto")).alias("between"))).alias("__later"))
    from_end = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ts")))
    rows = rows.join(sizes, list(KEY)).withColumn("__from_end", from_end)
    needed = F.filter("__later", lambda x: x["between"] + F.col("__from_end") <= reach)
    own = F.array(F.struct(F.col(SLICE).alias("to"), F.lit(False).alias("halo")))
    targets = F.concat(own, F.transform(needed, lambda x: F.struct(x["to"].alias("to"), F.lit(True).alias("halo")))) if reach > 0 else own
    return rows.select(*bars.columns, F.explode(targets).alias("__t")).select(*bars.columns, F.col("__t.to").alias(SLICE), F.col("__t.halo").alias("__halo"))


def bounded(bars: DataFrame, seconds: int, reach: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(bars), slice by slice. make: adds columns by windows of this package that together reach at most `reach` bars back."""
    with w.partitioned_by(*KEY):
        made = make(with_halo(bars, seconds, reach))
    return made.filter("not __halo").drop(SLICE, "__halo")


def with_carries(bars: DataFrame, seconds: int, filled: Mapping[str, str] | None = None, number: str | None = None, since: Mapping[str, str] | None = None) -> DataFrame:
    """bars with the carried columns asked for: number: the bar's number from 1; filled (out -> source): the source's last value that isn't missing;
    since (out -> condition): bars since the condition last held, missing before it did."""
    filled, since = dict(filled or {}), dict(since or {})
    rows = with_slices(bars, seconds)
    own = Window.partitionBy(*KEY).orderBy("ts")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__k", F.row_number().over(own))
    held = {f"__at_{out}": F.when(F.col(c), F.col("__k")) for out, c in since.items()}
    rows = rows.withColumns(held) if held else rows
    totals = rows.groupBy(*KEY).agg(
        F.max("__k").alias("__size"),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__k"))).alias(f"__last_{out}") for out, c in filled.items()),
        *(F.max(f"__at_{out}").alias(f"__last_at_{out}") for out in since),
    )
    totals = totals.withColumn("__before", _earlier(F.col("__size")))
    before = Window.partitionBy("symbol").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"__in_{out}": F.last(f"__last_{out}", ignorenulls=True).over(before) for out in filled}
    carried |= {f"__in_at_{out}": F.last(F.col(f"__last_at_{out}") + F.col("__before"), ignorenulls=True).over(before) for out in since}
    totals = totals.withColumns(carried).select(*KEY, "__before", *carried)
    rows = rows.join(totals, list(KEY))
    place = F.col("__before") + F.col("__k")
    out = {k: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"__in_{k}")) for k, c in filled.items()}
    out |= {k: place - F.coalesce(F.last(f"__at_{k}", ignorenulls=True).over(upto) + F.col("__before"), F.col(f"__in_at_{k}")) for k in since}
    out |= {number: place} if number else {}
    return rows.withColumns(out).select(*bars.columns, *out)


def with_recursion(bars: DataFrame, seconds: int, spec: Recursion) -> DataFrame:
    """bars with the recursion's column (on_gap "skip"). A slice is the map y -> a * y + b of what came before it; the seed is a number of the symbol's."""
    if spec.on_gap != "skip":
        raise ValueError("a recursion that seeds anew at a gap isn't carried over slices")
    if spec.alpha >= 1:
        return bars.withColumn(spec.out, F.col(spec.source))
    x, decay = F.col(spec.source), 1 - spec.alpha
    rows = with_slices(bars, seconds)
    own = Window.partitionBy(*KEY).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__v", F.count(x).over(own))  # the value's number in its slice, from 1
    # A slice is reduced to its count and its first n values: the seed comes from these, so that bars are never dealt by symbol.
    begins = F.sort_array(F.collect_list(F.when(x.isNotNull() & (F.col("__v") <= spec.n), F.struct(F.col("__v").alias("v"), x.cast("double").alias("x")))))
    counts = rows.groupBy(*KEY).agg(F.max("__v").alias("__valid"), begins.alias("__begins")).withColumn("__before", _earlier(F.col("__valid")))
    # A slice keeps those of them that are among the symbol's first n.
    seeding = F.filter("__begins", lambda t: t["v"] + F.col("__before") <= spec.n)
    every = Window.partitionBy("symbol").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seeds = F.flatten(F.collect_list(F.transform(seeding, lambda t: t["x"])).over(every))
    counts = counts.withColumn("__seeds", seeds)
    seed = F.aggregate("__seeds", F.lit(0.0), lambda a, b: a + b) / spec.n
    counts = counts.select(*KEY, "__before", F.when(F.size("__seeds") == spec.n, seed).alias("__seed"))
    rows = rows.join(counts, list(KEY)).withColumn("__number", F.col("__before") + F.col("__v"))
    there = x.isNotNull() & (F.col("__number") >= spec.n)
    given = F.when(F.col("__number") == spec.n, F.col("__seed")).otherwise(spec.alpha * x)
    # Within a slice as by symbol: blocks, a running sum with growing weights, and the end of the block before.
    length = block_length(spec.alpha)
    at = F.pmod(F.col("__v") - 1, F.lit(length))
    rows = rows.withColumns({"__block": F.floor((F.col("__v") - 1) / length), "__there": there, "__x": F.when(there, given / F.pow(F.lit(decay), at))})
    block = Window.partitionBy(*KEY, "__block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__z", F.coalesce(F.sum("__x").over(block), F.lit(0.0)) * F.pow(F.lit(decay), at))
    end = F.last(F.when(x.isNotNull() & (at == length - 1), F.col("__z")), ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__local", F.col("__z") + F.coalesce(end * F.pow(F.lit(decay), at + 1), F.lit(0.0)))
    maps = rows.filter(x.isNotNull()).groupBy(*KEY).agg(F.max("__v").alias("m"), F.max_by("__local", "ts").alias("b"))
    maps = maps.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.col(SLICE).alias("s"), "m", "b"))).alias("maps"))
    # Each slice takes up what the maps before it make of nothing. The fold keeps one entry for each slice of the symbol.
    step = "(acc, t) -> named_struct('y', acc.y * pow({d}, t.m) + t.b, 'all', concat(acc.all, array(named_struct('s', t.s, 'y', acc.y))))".format(d=repr(decay))
    empty = "named_struct('y', 0.0D, 'all', cast(array() as array<struct<s: bigint, y: double>>))"
    ins = maps.select("symbol", F.explode(F.expr(f"aggregate(maps, {empty}, {step}, acc -> acc.all)")).alias("t")).select("symbol", F.col("t.s").alias(SLICE), F.col("t.y").alias("__y"))
    rows = rows.join(ins, list(KEY), "left")
    y = F.col("__local") + F.coalesce(F.col("__y") * F.pow(F.lit(decay), F.col("__v")), F.lit(0.0))
    return rows.withColumn(spec.out, F.when(F.col("__there"), F.when(F.col("__number") == spec.n, F.col("__seed")).otherwise(y))).select(*bars.columns, spec.out)


def seconds_for(bars: DataFrame, rows: int) -> int:
    """A length of slices with about so many bars of the densest symbol; reads only counts and bounds by symbol."""
    by = bars.groupBy("symbol").agg(F.count("*").alias("n"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("span")).filter("span > 0")
    rate = by.agg(F.max(F.col("n") / F.col("span")).alias("r")).first()["r"]
    return max(1, math.ceil(rows / rate)) if rate else 1
