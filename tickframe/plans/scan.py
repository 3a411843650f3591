"""The scan: engines over all symbols' bars, one row a symbol, composite and signal, filter, order and limit."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, half_even, signal_tier
from ..operators import window as w
from ..operators.recursive import Recursion, with_recursions
from ..predicate import apply_filter
from ..timeframe import eastern
from . import flow, momentum, regime
from .flow import Flow
from .momentum import Momentum
from .regime import Regime


BARS = ("symbol", "ts", "open", "high", "low", "close", "volume", "session")


@dataclass(frozen=True)
class Engine:
    """prefix of its columns, the bars it needs, and what adds the columns: compute, or what comes before its recursions, these with the columns they
    leave spent, and what comes after. error: a column in which compute says what went wrong with a symbol."""

    prefix: str
    warmup: int
    compute: Callable[[DataFrame], DataFrame] | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    recursions: tuple[list[Recursion], list[str]] = ((), ())
    finish: Callable[[DataFrame], DataFrame] | None = None
    error: str | None = None


def builtin_engines(m: Momentum = Momentum(), r: Regime = Regime(), f: Flow = Flow()) -> list[Engine]:
    made = ((momentum, "mb", m), (regime, "ggr", r), (flow, "sf", f))
    return [Engine(prefix, c.warmup, None, partial(plan.prepare, c=c), plan.recursions(c), partial(plan.finish, c=c)) for plan, prefix, c in made]


def with_engines(bars: DataFrame, engines: list[Engine], longest: int | None = None) -> DataFrame:
    """bars with the columns of all engines: one grouped pass for the recursions of all that have some, whose inputs need no other engine.
    longest: no symbol has more bars."""
    joint = [e for e in engines if e.compute is None]
    for e in joint:
        bars = e.prepare(bars)
    if joint:
        bars = with_recursions(bars, *(x for e in joint for x in e.recursions[0]), spent=[c for e in joint for c in e.recursions[1]], longest=longest)
    for e in joint:
        bars = e.finish(bars)
    for e in engines:
        bars = e.compute(bars) if e.compute else bars
    return bars


@dataclass(frozen=True)
class ScanRequest:
    lookback: int = 300
    filter: str | None = None
    sort: str = "mb_score"
    descending: bool = True
    limit: int = 0
    engines: list[Engine] = field(default_factory=builtin_engines)

    @property
    def warmup(self) -> int:
        return max((e.warmup for e in self.engines), default=0)


def short_history(bars: DataFrame, least: int) -> DataFrame:
    """symbol, error of the symbols with fewer bars than the engines need."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") < least)
    return n.select("symbol", F.format_string(f"only %d bars, {least} are needed", "n").alias("error"))


def missing_symbols(watchlist: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, error of the watched symbols without bars."""
    return watchlist.join(bars.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit("no data returned").alias("error"))


def base_columns(bars: DataFrame) -> DataFrame:
    """last_price, pct_chg, day_chg, above_sma50, new_high, last_bar on every bar; right on each symbol's last one."""
    close = F.col("close")
    day = F.to_date(eastern(F.col("ts")))
    bars = bars.withColumns({"__day": day, "__prev": w.lag(close), "__mean": F.avg(close).over(w.last_rows(50)), "__high": F.max(close).over(w.by_symbol().rowsBetween(Window.unboundedPreceding, 0))})
    # The last close before this bar's Eastern date: carried from where the date changes.
    bars = bars.withColumn("__new", F.coalesce(F.col("__day") != w.lag(F.col("__day")), F.lit(False)))
    bars = bars.withColumn("__before", F.coalesce(w.ffill(F.when(F.col("__new"), F.col("__prev"))), F.col("__prev")))
    return bars.withColumns(
        {
            "last_price": close,
            "pct_chg": F.coalesce((close / F.col("__prev") - 1) * 100.0, F.lit(0.0)),
            "day_chg": F.coalesce((close / F.col("__before") - 1) * 100.0, F.lit(0.0)),
            "above_sma50": close > F.col("__mean"),
            "new_high": close >= F.col("__high"),
            "last_bar": F.col("ts"),
        }
    ).drop("__day", "__prev", "__mean", "__high", "__new", "__before")


def snapshot(bars: DataFrame) -> DataFrame:
    """Each symbol's last bar."""
    return bars.withColumn("__last", F.lead("ts").over(w.by_symbol()).isNull()).filter("__last").drop("__last")


def with_composite(rows: DataFrame) -> DataFrame:
    """composite, the mean of three legs from 0 to 100 with one digit, and signal; only if the three columns are there."""
    if not {"mb_score", "ggr_state", "sf_inst_bias"} <= set(rows.columns):
        return rows
    legs = clip(50.0 + F.col("mb_score"), 0.0, 100.0) + (F.col("ggr_state") + 3) / 6.0 * 100.0 + clip((F.col("sf_inst_bias") + 1.0) / 2.0 * 100.0, 0.0, 100.0)
    return rows.withColumn("composite", half_even(legs / 3.0)).withColumn("signal", signal_tier(F.col("composite")))


def ranked(rows: DataFrame, sort: str, descending: bool = True, limit: int = 0) -> DataFrame:
    """Ordered by sort, missing last, equal values by symbol; an unknown column doesn't order. limit 0: all."""
    if sort in rows.columns:
        rows = rows.orderBy(F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last(), "symbol")
    return rows.limit(limit) if limit > 0 else rows


def scan_table(bars: DataFrame, request: ScanRequest = ScanRequest()) -> DataFrame:
    """One row for each symbol that has bars, from one pass over them: base columns, the engines' columns, composite and signal, and error, which is
    NULL where all went well: too few bars, or what an engine says of the symbol. An error of one symbol leaves the others alone."""
    last = max(request.lookback, request.warmup + 30) if request.lookback else 0
    # The last bars are told by number and count in the order that all later windows have: one sort.
    numbered = bars.select(*BARS).withColumns({"__i": w.bar_number(), "__bars": F.count("*").over(Window.partitionBy("symbol"))})
    numbered = numbered.filter(F.col("__i") > F.col("__bars") - last) if last else numbered
    # The engines follow one another over the same sorted bars, so that these are made once; a symbol with too few bars has none of their values.
    based, enough = base_columns(numbered.drop("__i")), F.col("__bars") >= request.warmup
    out = snapshot(with_engines(based, [e for e in request.engines if e.compute is None], last or None))
    made = [c for c in out.columns if c not in based.columns]
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in made}).drop(*BARS[1:])
    # What computes for itself (scripts) runs over narrow bars of its own, only of symbols that have enough, and is met at the last bar.
    for e in request.engines:
        if e.compute:
            out = out.join(snapshot(e.compute(numbered.filter(enough).select(*BARS))).drop(*BARS[1:]), "symbol", "left")
    short = F.when(~enough, F.format_string(f"only %d bars, {request.warmup} are needed", "__bars"))
    failed = [F.concat(F.lit(f"{e.prefix}: "), F.col(e.error)) for e in request.engines if e.error]
    return with_composite(out.withColumn("error", F.coalesce(short, *failed)).drop("__bars", *(e.error for e in request.engines if e.error)))


def scan_rows(bars: DataFrame, request: ScanRequest = ScanRequest()) -> DataFrame:
    """One row for each symbol with enough bars and no engine error."""
    return scan_table(bars, request).filter("error is null").drop("error")


@dataclass
class ScanResult:
    """rows (filtered, ordered, limited) and errors read one table, which one pass over the bars fills."""

    rows: DataFrame
    errors: DataFrame
    meta: dict
    table: DataFrame

    def observed(self, now: datetime | None = None) -> dict:
        """meta, and of the pass that fills the table, before filter and limit: symbols requested, scanned and failed, the newest bar, and with `now`
        (with a zone) its age in minutes. Asked for first, it is that pass; rows and errors read the table then."""
        observation, failed = Observation(f"scan-{uuid.uuid4().hex}"), F.col("error").isNotNull()
        counts = (F.count("*").alias("requested"), F.count_if(~failed).alias("scanned"), F.count_if(failed).alias("failed"), F.max("last_bar").alias("newest_bar"))
        self.table.observe(observation, *counts).write.format("noop").mode("overwrite").save()
        seen = observation.get
        newest = seen["newest_bar"]
        age = None if newest is None or now is None else round((now - newest.replace(tzinfo=now.tzinfo)).total_seconds() / 60.0, 1)
        return self.meta | seen | {"age_minutes": age}

    def release(self) -> None:
        """Gives back what the table holds in memory or on disk."""
        self.table.unpersist()


def scan(bars: DataFrame, request: ScanRequest = ScanRequest(), watchlist: DataFrame | None = None, now: datetime | None = None) -> ScanResult:
    """The whole scan. A symbol with too few bars or none, or with an engine's error, is an error row, not a result."""
    if watchlist is not None:
        watch = watchlist.select("symbol").distinct()
        table = scan_table(bars.join(watch, "symbol", "left_semi"), request)
        none = F.when(F.col("last_bar").isNull(), F.lit("no data returned"))
        table = watch.join(table, "symbol", "left").withColumn("error", F.coalesce("error", none))
    else:
        table = scan_table(bars, request)
    table = table.persist()
    rows = ranked(apply_filter(table.filter("error is null").drop("error"), request.filter), request.sort, request.descending, request.limit)
    errors = table.filter("error is not null").select("symbol", "error").orderBy("symbol")
    meta = {"filter": request.filter or "", "as_of": now.isoformat() if now else None, "lookback": max(request.lookback, request.warmup + 30)}
    return ScanResult(rows, errors, meta, table)
