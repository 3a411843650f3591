"""The engine's queries over the driver's tables. Floating results are quantised to 1e-6, as in their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.sessions import drop_incomplete, rth_only, session_counts, trim_delay
from .operators import recursive as rec
from .operators import slices as sl
from .operators import window as w
from .operators.resample import closed_value, dedup_keep_last, resample_ohlcv, tail
from .plans import overview as ov
from .plans import scan as sc
from .plans.flow import Flow, flow
from .plans.momentum import Momentum, momentum
from .plans.regime import Regime, regime
from .schema import violations
from .script.engine import source_engine, with_script
from .sources.bars import daily_from_lineitem, daily_in_slices, from_events
from .timeframe import Timeframe, bucket

NOW = datetime(2024, 1, 20, 12, 0, 0)
KEYS = ("symbol", "ts")


def quantised(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c, t in df.dtypes if t == "double"})


def daily(spark, sf_dir) -> DataFrame:
    return daily_from_lineitem(spark, sf_dir)


def hourly(spark, sf_dir) -> DataFrame:
    return from_events(spark, sf_dir, Timeframe.H1)


def _columns(bars, **columns) -> DataFrame:
    return quantised(bars.select(*KEYS, *(c.alias(k) for k, c in columns.items())))


def _window(**columns):
    return lambda spark, sf_dir: _columns(daily(spark, sf_dir), **{k: f(F.col("close")) for k, f in columns.items()})


def _recursive(*specs):
    return lambda spark, sf_dir: quantised(rec.with_recursions(daily(spark, sf_dir), *specs).select(*KEYS, *(s.out for s in specs)))


def _prefixed(bars: DataFrame, prefix: str) -> DataFrame:
    return quantised(bars.select(*KEYS, *(c for c in bars.columns if c.startswith(prefix + "_"))))


def dedup(spark, sf_dir) -> DataFrame:
    """The last event of each user and type by (ts, event_id)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "event_id", "value")
    return dedup_keep_last(e, ["user_id", "event_type"], F.col("ts"), F.col("event_id"))


def crosses(spark, sf_dir) -> DataFrame:
    b = daily(spark, sf_dir).withColumns({"f": w.sma(F.col("close"), 8), "s": w.sma(F.col("close"), 20)})
    b = b.withColumns({"up": w.crossover(F.col("f"), F.col("s")), "down": w.crossunder(F.col("f"), F.col("s")), "n": w.bar_number()})
    b = b.withColumn("since", w.bars_since(F.col("up"), F.col("n")))
    above = w.rising_edge(F.col("f") > F.col("s"))
    return quantised(b.select(*KEYS, "up", "down", "since", above.alias("edge"), w.ffill(F.when(F.col("up"), F.col("close"))).alias("last_up")))


def htf_closed(spark, sf_dir) -> DataFrame:
    b = hourly(spark, sf_dir)
    at = bucket(F.col("ts"), 4 * 3600)
    higher = resample_ohlcv(b, at).withColumnsRenamed({"close": "htf_close", "volume": "htf_volume"})
    return quantised(closed_value(b.select(*KEYS), at, higher, "htf_close", "htf_volume"))


def sliced_windows(spark, sf_dir) -> DataFrame:
    """The windows of `sma` and `stdev_pop` over slices of 90 days, so that a symbol's bars lie in several tasks."""
    x = F.col("close")
    out = sl.bounded(daily_from_lineitem(spark, sf_dir, whole_symbols=False), 90 * 86400, 19, lambda b: b.withColumns({"sma20": w.sma(x, 20), "sd20": w.stdev_pop(x, 20), "mom10": w.change(x, 10)}))
    return quantised(out.select(*KEYS, "sma20", "sd20", "mom10"))


def sliced_carries(spark, sf_dir) -> DataFrame:
    """Bar numbers, the last close of a falling bar, bars since one, and an average without bound, carried over slices of 90 days."""
    b = daily_in_slices(spark, sf_dir, 90 * 86400).withColumn("falls", F.col("close") < F.col("open"))
    b = b.withColumn("fell_at", F.when(F.col("falls"), F.col("close")))
    out = sl.with_carries(b, 90 * 86400, {"last_fall": "fell_at"}, "number", {"since": "falls"})
    return quantised(sl.with_recursion(out, 90 * 86400, rec.rma("rma14", "close", 14)).select(*KEYS, "number", "last_fall", "since", "rma14"))


def scanned(spark, sf_dir) -> DataFrame:
    return sc.scan_rows(daily(spark, sf_dir))


SNAPSHOT = ("symbol", "last_price", "pct_chg", "day_chg", "above_sma50", "new_high", "last_bar", "mb_score", "mb_state", "ggr_state", "sf_inst_bias", "sf_regime", "composite", "signal")


def scan_snapshot(spark, sf_dir) -> DataFrame:
    return quantised(scanned(spark, sf_dir).select(*SNAPSHOT))


def scan_filter_topk(spark, sf_dir) -> DataFrame:
    """The 20 best of those the filter leaves: the limit is the feature."""
    rows = sc.apply_filter(scanned(spark, sf_dir), "mb_score > -20 and (ggr_state >= 0 or above_sma50) and not (pct_chg > 60)")
    return quantised(sc.ranked(rows, "composite", True, 20).select("symbol", "composite", "signal", "mb_score", "ggr_state"))


def watchlist(spark, sf_dir) -> DataFrame:
    """Suppliers in credit, and one symbol that has no bars."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return own.union(spark.createDataFrame([("NONE",)], "symbol string"))


def missing(spark, sf_dir) -> DataFrame:
    return sc.missing_symbols(watchlist(spark, sf_dir), daily(spark, sf_dir))


def starred(spark, sf_dir) -> DataFrame:
    rows = sc.snapshot(sc.base_columns(daily(spark, sf_dir))).select("symbol", "last_price", "day_chg")
    return quantised(ov.starred(watchlist(spark, sf_dir), rows))


def tape(spark, sf_dir) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("label"))
    return quantised(ov.tape(daily(spark, sf_dir), labels))


def user_history(spark, sf_dir) -> DataFrame:
    """Users with too few hourly bars for the engines: error rows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("symbol"), bucket(F.col("ts").cast("timestamp"), 3600).alias("ts")).distinct()
    return sc.short_history(e, 118)


#: Scripts that say the same as native queries, and so share their SQL.
SCRIPTS = {
    "sma": 'plot(ta.sma(close, 8), "sma8")\nplot(ta.sma(close, 20), "sma20")',
    "stdev_pop": 'plot(ta.stdev(close, 20), "sd20")',
    "rolling_sum": 'plot(math.sum(close, 13), "sum13")',
    "rolling_median": 'plot(ta.median(close, 9), "med9")',
    "highest_lowest": 'plot(ta.highest(close, 10), "hi10")\nplot(ta.lowest(close, 10), "lo10")',
    "change": 'plot(ta.change(close), "chg1")\nplot(close - close[10], "mom10")',
    "percentrank": 'plot(ta.percentrank(close, 50), "pr")',
    "ema": 'plot(ta.ema(close, 12), "ema12")',
    "rma": 'plot(ta.rma(close, 14), "rma14")',
    "rsi": 'plot(ta.rsi(close, 14), "rsi14")',
    "atr": 'plot(ta.atr(14), "atr14")',
    "crosses": """
f = ta.sma(close, 8)
s = ta.sma(close, 20)
up = ta.crossover(f, s)
above = f > s ? true : false
var float last = na
if up
    last := close
plotshape(up, "up")
plotshape(ta.crossunder(f, s), "down")
plot(ta.barssince(up), "since")
plotshape(above and not above[1] or above and barstate.isfirst, "edge")
plot(last, "last_up")
""",
}


#: A user function, one that returns a tuple, an array, an input, history and the mathematical functions.
FEATURES = """
indicator("Features", shorttitle="ft")
len = input.int(8, "Length")
spread(a, b) => a - b
both(x, n) =>
    m = ta.sma(x, n)
    d = x - m
    [m, d]
[mean, dev] = both(close, len)
var box = array.new<float>()
array.push(box, close)
if array.size(box) > 3
    array.shift(box)
plot(mean, "mean")
plot(dev, "dev")
plot(nz(spread(close, close[2]), -1), "gap")
plot(array.avg(box), "box_avg")
plot(close > open ? math.sqrt(volume) : math.abs(open - close), "pick")
plot(math.max(math.floor(high), math.ceil(low)) + math.min(math.sign(close - open), 0), "whole")
"""
#: Timeframes of the queries of higher ones.
HIGHER = ("60", "240", "D", "W")
#: Fails on a symbol whose first bar closes at 1400 or less: the array is empty there.
FAILING = """
var seen = array.new<float>()
if close > 1400
    array.push(seen, close)
plot(array.get(seen, 0), "first")
"""
#: Every operator of the filter language but those over engine columns.
EVERY_OPERATOR = "((last_price * 2 - 1 >= 3000 or pct_chg ** 2 < 1) and not new_high and -50 < day_chg <= 50 and last_price % 7 > 1 and last_price not in [1, 2]) | (above_sma50 & last_price / 2 + 0.5 != 700) | (last_price % -7 > -1 and day_chg / 0 < 0)"


def script_features(spark, sf_dir) -> DataFrame:
    out = with_script(daily(spark, sf_dir), FEATURES, prefix="x")
    return quantised(out.select(*KEYS, *(F.col(c).cast("double").alias(c[2:]) for c in out.columns if c.startswith("x_"))))


def _higher(timeframe: str):
    """Values of a higher timeframe on quarter-hour bars: of the last closed bucket, and (look-ahead) of the bucket that is still open."""
    source = f"""
m = ta.sma(close, 3)
[last, mean] = request.security(syminfo.tickerid, "{timeframe}", [close, m])
plot(last, "last")
plot(mean, "mean")
plot(request.security(syminfo.tickerid, "{timeframe}", high - low + volume, lookahead = barmerge.lookahead_on), "ahead")
plot(request.security(syminfo.tickerid, "{timeframe}", close[1], lookahead = barmerge.lookahead_on), "before")
"""

    def query(spark, sf_dir) -> DataFrame:
        out = with_script(from_events(spark, sf_dir, Timeframe.M15), source, prefix="x")
        return quantised(out.select(*KEYS, *(F.col(c).alias(c[2:]) for c in out.columns if c.startswith("x_"))))

    return query


def filter_operators(spark, sf_dir) -> DataFrame:
    rows = sc.snapshot(sc.base_columns(daily(spark, sf_dir))).select("symbol", "last_price", "pct_chg", "day_chg", "above_sma50", "new_high")
    return quantised(sc.apply_filter(rows, EVERY_OPERATOR))


def tick_violations(spark, sf_dir) -> DataFrame:
    """The rules of the bar contract on raw ticks, which repeat keys and have other sessions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    price = F.col("value")
    ticks = e.select(F.col("event_type").alias("symbol"), bucket(F.col("ts").cast("timestamp"), 60).alias("ts"), price.alias("open"), (price - 1).alias("high"), price.alias("low"), price.alias("close"))
    close = F.col("close")
    return violations(ticks.withColumns({"volume": close - 50, "session": F.when(close > 10, "rth").when(close > 5, "night")}))


def scan_errors(spark, sf_dir) -> DataFrame:
    """Watched symbols without bars, with too few for the engines of a slow flow, or on which a script fails."""
    engines = [*sc.builtin_engines(f=Flow(gate_len=480)), sc.Engine(**source_engine(FAILING, "failing"))]
    return sc.scan(daily(spark, sf_dir), sc.ScanRequest(engines=engines), watchlist(spark, sf_dir)).errors


def scan_meta(spark, sf_dir) -> DataFrame:
    """What a scan with a filter and a limit observes in the one pass over its bars."""
    request = sc.ScanRequest(filter="mb_score > 0", limit=3, engines=[*sc.builtin_engines(), sc.Engine(**source_engine(FAILING, "failing"))])
    result = sc.scan(daily(spark, sf_dir), request, watchlist(spark, sf_dir))
    seen = result.observed()
    result.release()
    return spark.createDataFrame([tuple(seen[k] for k in ("requested", "scanned", "failed", "newest_bar"))], "requested long, scanned long, failed long, newest_bar timestamp")


def _script(name: str):
    def query(spark, sf_dir) -> DataFrame:
        out = with_script(daily(spark, sf_dir), SCRIPTS[name], prefix="x")
        added = [c for c in out.columns if c.startswith("x_")]
        out = quantised(out.select(*KEYS, *(F.col(c).alias(c[2:]) for c in added)))
        return out.withColumn("since", F.col("since").cast("int")) if "since" in out.columns else out

    return query


QUERIES = {
    "bars_daily": lambda s, d: quantised(daily_from_lineitem(s, d, whole_symbols=False)),
    "bars_hourly": lambda s, d: quantised(hourly(s, d)),
    "session_counts": lambda s, d: session_counts(from_events(s, d, Timeframe.M15)),
    "dedup_keep_last": lambda s, d: quantised(dedup(s, d)),
    "tail_n": lambda s, d: quantised(tail(daily(s, d), 30)),
    "drop_incomplete": lambda s, d: quantised(drop_incomplete(hourly(s, d).filter(F.col("ts") <= F.lit(NOW)), Timeframe.H1, NOW)),
    "sma": _window(sma8=lambda x: w.sma(x, 8), sma20=lambda x: w.sma(x, 20)),
    "stdev_pop": _window(sd20=lambda x: w.stdev_pop(x, 20)),
    "rolling_sum": _window(sum13=lambda x: w.rolling_sum(x, 13)),
    "rolling_median": _window(med9=lambda x: w.rolling_median(x, 9)),
    "highest_lowest": _window(hi10=lambda x: w.highest(x, 10), lo10=lambda x: w.lowest(x, 10)),
    "change": _window(chg1=lambda x: w.change(x), mom10=lambda x: w.change(x, 10)),
    "percentrank": lambda s, d: _columns(daily(s, d).withColumn("e", w.before(F.col("close"), 50)), pr=w.share_at_most(F.col("e"), F.col("close"), 50)),
    "ema": _recursive(rec.ema("ema12", "close", 12)),
    "rma": _recursive(rec.rma("rma14", "close", 14)),
    "rsi": lambda s, d: quantised(rec.with_rsi(daily(s, d), "rsi14", "close", 14).select(*KEYS, "rsi14")),
    "atr": lambda s, d: quantised(rec.with_atr(daily(s, d), "atr14", 14).select(*KEYS, "atr14")),
    "crosses": crosses,
    "sliced_windows": sliced_windows,
    "sliced_carries": sliced_carries,
    "momentum_velocity": lambda s, d: _prefixed(momentum(daily(s, d)), "mb"),
    "momentum_position": lambda s, d: _prefixed(momentum(hourly(s, d), Momentum(mode="position", stars_fresh_only=True)), "mb"),
    "regime_default": lambda s, d: _prefixed(regime(daily(s, d)), "ggr"),
    "regime_htf": lambda s, d: _prefixed(regime(from_events(s, d, Timeframe.M15), Regime(rsi_htf=Timeframe.H1)), "ggr"),
    "flow_share": lambda s, d: _prefixed(flow(daily(s, d)), "sf"),
    "flow_signed_zscore": lambda s, d: _prefixed(flow(daily(s, d), Flow(gate_mode="zscore", retail_thr=0.0, inst_thr=1.0, scale_mode="signed", weight_mode="directional", double_smooth=True)), "sf"),
    "flow_independent_hard": lambda s, d: _prefixed(flow(daily(s, d), Flow(scale_mode="independent", soft_gate=False, edge_only=False)), "sf"),
    "resample_ohlcv": lambda s, d: quantised(resample_ohlcv(hourly(s, d), bucket(F.col("ts"), 4 * 3600))),
    "htf_closed_value": htf_closed,
    "scan_snapshot": scan_snapshot,
    "scan_filter_topk": scan_filter_topk,
    "overview": lambda s, d: quantised(ov.overview(scanned(s, d))),
    "top_signals": lambda s, d: quantised(ov.top_signals(scanned(s, d))),
    "missing_symbols": missing,
    "starred_lookup": starred,
    "tape": tape,
    "short_history": user_history,
    "rth_only": lambda s, d: quantised(rth_only(hourly(s, d))),
    "trim_delay": lambda s, d: quantised(trim_delay(from_events(s, d, Timeframe.M15), Timeframe.M15, NOW, 900)),
    "filter_operators": filter_operators,
    "bar_violations": tick_violations,
    "scan_errors": scan_errors,
    "scan_meta": scan_meta,
    "script_features": script_features,
} | {f"script_{name}": _script(name) for name in SCRIPTS} | {f"script_security_{t.lower()}": _higher(t) for t in HIGHER}
