"""python -m tickframe.app.cli scan|sources|doctor: a scan of a bar table (or of the driver's tables) from the command line."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sessions import rth_only, session_counts
from ..plans.scan import ScanRequest, scan
from ..schema import normalised
from ..sources.bars import daily_from_lineitem, from_events
from ..timeframe import Timeframe
from .config import Config, load_config, load_watchlist
from .sinks import table_lines, write_csv, write_json, write_parquet

SOURCES = {
    "table": "Parquet folder with the bar contract",
    "lineitem": "daily bars from a folder with lineitem.parquet",
    "events": "intraday bars from a folder with events.parquet",
}


def value_of(text: str) -> bool | int | float | str:
    """true and false, whole numbers, numbers, else the text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def read_bars(spark: SparkSession, source: str, path: str, timeframe: Timeframe, extended: bool = True, symbols: list[str] | None = None) -> DataFrame:
    """Bars with symbols in upper case, as in watchlists. symbols: only those; of a bar table, which holds them in upper case, no others are read."""
    if source == "lineitem":
        bars = daily_from_lineitem(spark, path)
    elif source == "events":
        bars = from_events(spark, path, timeframe)
    elif source == "table":
        bars = normalised(spark.read.parquet(path))
    else:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(SOURCES)}")
    if source != "table":
        bars = bars.withColumn("symbol", F.upper("symbol"))
    bars = bars if symbols is None else bars.filter(F.col("symbol").isin(symbols))
    return bars if extended else rth_only(bars)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickframe")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="one row a symbol, ranked")
    s.add_argument("watchlist", help="a file, symbols with commas between, or * for all")
    s.add_argument("--filter")
    s.add_argument("--sort")
    s.add_argument("--limit", type=int)
    s.add_argument("--lookback", type=int)
    s.add_argument("--rth-only", action="store_true")
    s.add_argument("--script", action="append", default=[])
    s.add_argument("--input", action="append", default=[], help="title=value, for the scripts given here")
    for kind in ("json", "csv", "parquet"):
        s.add_argument(f"--{kind}")
    d = sub.add_parser("doctor", help="sessions and newest bar of a source")
    sub.add_parser("sources", help="what can be read")
    for q in (s, d):
        q.add_argument("--source", choices=SOURCES)
        q.add_argument("--path", required=True)
        q.add_argument("--timeframe")
        q.add_argument("--config")
    return p


def request_of(args: argparse.Namespace, config: Config) -> ScanRequest:
    given = dict(x.split("=", 1) for x in args.input)
    inputs = {k.strip(): value_of(v.strip()) for k, v in given.items()}
    own = config.scan
    pick = lambda a, b: b if a is None else a
    return ScanRequest(
        pick(args.lookback, own.lookback), pick(args.filter, own.filter) or None, pick(args.sort, own.sort), own.descending, pick(args.limit, own.limit),
        config.engines({p: inputs for p in args.script}),
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    """Exit code: 1 for a scan without rows but with errors, or a doctor that finds no bars."""
    args = _parser().parse_args(argv)
    if args.command == "sources":
        print(*(f"{k}: {v}" for k, v in SOURCES.items()), sep="\n", file=out)
        return 0
    config = load_config(args.config)
    spark = spark or SparkSession.builder.appName("tickframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    source, frame = args.source or config.scan.provider, Timeframe.parse(args.timeframe or config.scan.timeframe)
    if args.command == "doctor":
        bars = read_bars(spark, source, args.path, frame)
        counts = session_counts(bars).groupBy("session").agg(F.sum("n").alias("n")).collect()
        newest = bars.agg(F.max("ts").alias("ts")).first().ts
        print(*(f"{r.session}: {r.n} bars" for r in sorted(counts, key=lambda r: str(r.session))), f"newest bar: {newest}", sep="\n", file=out)
        return 0 if newest else 1
    symbols = None if args.watchlist == "*" else load_watchlist(args.watchlist)
    bars = read_bars(spark, source, args.path, frame, config.scan.include_extended and not args.rth_only, symbols)
    watch = None if symbols is None else spark.createDataFrame([(s,) for s in symbols], "symbol string")
    result = scan(bars, request_of(args, config), watch, datetime.now(timezone.utc))
    result.meta |= {"timeframe": frame.value, "source": source}
    seen = result.observed(datetime.now(timezone.utc))
    rows = list(table_lines(result))
    print(*rows, f"{seen['scanned']} of {seen['requested']} symbols, newest bar {seen['newest_bar']}, {seen['age_minutes']} minutes old", sep="\n", file=out)
    if args.json:
        write_json(result, args.json)
    if args.csv:
        write_csv(result.rows, args.csv)
    if args.parquet:
        write_parquet(result.rows, args.parquet)
    result.release()
    errors = sum(x.startswith("skipped ") for x in rows)
    return 1 if errors and len(rows) == 1 + errors else 0


if __name__ == "__main__":
    sys.exit(main())
