"""A scan's result as Parquet, CSV, JSON or text. Parquet and CSV are written by the executors; JSON and text are reports of a scan that one
reader looks at: one row a symbol of a watchlist, taken in batches by an iterator, never all at once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import ScanResult

#: Columns shown first, those not shown, and endings of columns that hold a signed state.
SHOWN = ("last_price", "day_chg", "composite", "signal", "mb_score", "mb_state", "mb_rvol", "ggr_state", "sf_inst_bias", "sf_regime")
HIDDEN = ("last_bar", "pct_chg", "above_sma50", "new_high")
NATIVE = ("mb_", "ggr_", "sf_")
STATES = ("state", "regime", "flip", "star", "confluence", "tier")


def plain(value):
    """For JSON: times as ISO text, whole numbers of state columns stay numbers."""
    return value.isoformat() if isinstance(value, (datetime, date)) else value


def whole_states(rows: DataFrame) -> DataFrame:
    """Columns named after a state that are floating and hold whole numbers only are given as integers where they are."""
    out = {c: F.when(F.col(c) == F.floor(c), F.col(c).cast("bigint")).otherwise(None) for c, t in rows.dtypes if t == "double" and c.endswith(STATES)}
    return rows.withColumns(out) if out else rows


def write_parquet(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).parquet(path)


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of parts, each with a header; times as ISO text."""
    rows.select(*(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c) if t == "timestamp" else F.col(c) for c, t in rows.dtypes)).write.mode(mode).csv(path, header=True)


def json_parts(result: ScanResult) -> Iterator[str]:
    """The text of {"rows": {symbol: {...}}, "errors": {symbol: text}, "meta": ...} in pieces; meta comes last, for it holds what reading the rows showed."""
    yield '{"rows": {'
    for i, r in enumerate(result.rows.toLocalIterator()):
        d = {k: plain(v) for k, v in r.asDict().items() if k != "symbol"}
        yield (", " if i else "") + json.dumps(r.symbol) + ": " + json.dumps(d)
    yield '}, "errors": {'
    for i, r in enumerate(result.errors.toLocalIterator()):
        yield (", " if i else "") + json.dumps(r.symbol) + ": " + json.dumps(r.error)
    yield '}, "meta": ' + json.dumps({k: plain(v) for k, v in result.observed(datetime.now(timezone.utc)).items()}) + "}"


def write_json(result: ScanResult, path: str | Path) -> None:
    with open(path, "w") as out:
        out.writelines(json_parts(result))


def cell(name: str, value) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "."
    if name.endswith(STATES) and isinstance(value, (int, float)):
        return f"{int(value):+d}" if value else "0"
    if name in ("day_chg", "pct_chg"):
        return f"{value:+.2f}%"
    return f"{value:,.2f}" if isinstance(value, float) else str(value)


def table_lines(result: ScanResult) -> Iterator[str]:
    """Lines of a text table: known columns, then the scripts' ones, then the errors."""
    have = result.rows.columns
    columns = [c for c in SHOWN if c in have]
    columns += [c for c in have if c not in columns and c not in HIDDEN and c != "symbol" and not c.startswith(NATIVE)]
    if result.meta.get("delay_seconds"):
        yield f"data is about {result.meta['delay_seconds'] // 60} minutes late"
    yield "  ".join(["symbol".ljust(8), *(c.rjust(max(len(c), 10)) for c in columns)])
    for r in result.rows.select("symbol", *columns).toLocalIterator():
        yield "  ".join([r.symbol.ljust(8), *(cell(c, r[c]).rjust(max(len(c), 10)) for c in columns)])
    for r in result.errors.toLocalIterator():
        yield f"skipped {r.symbol}: {r.error}"
