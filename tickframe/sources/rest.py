"""Bars from REST interfaces as a Spark data source: spark.read.format("market_bars"), after register(spark).

A partition is a group of symbols, so that executors fetch side by side; an interface with a request cap gets one partition and a token
bucket. Pages are followed to the end and given out as they come. A symbol that fails gives one row with its error and no bar.
Options: vendor (alpaca or polygon), symbols (commas between), timeframe, lookback, group (symbols a partition), base (another address),
feed, tier, end (ISO time, default now), env_file. Keys come from the environment or env_file on the driver,
and go to the executors with the reader; they are never in options or addresses.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.sessions import drop_incomplete, rth_only, tag_sessions, trim_delay
from ..operators.resample import tail
from ..timeframe import Timeframe

#: Fixed values of the public interfaces.
ADDRESS = {"alpaca": "https://data.alpaca.markets", "polygon": "https://api.polygon.io"}
ALPACA_FRAMES = {"1m": "1Min", "5m": "5Min", "15m": "15Min", "1h": "1Hour", "1D": "1Day"}
POLYGON_FRAMES = {"1m": "1/minute", "5m": "5/minute", "15m": "15/minute", "1h": "1/hour", "1D": "1/day"}
FREE_DELAY, FREE_CAP = 900, 5
SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, page long, error string"


class NotConfigured(ValueError):
    pass


class TokenBucket:
    """wait() returns when one more request fits so many a minute."""

    def __init__(self, per_minute: int, now=time.monotonic, sleep=time.sleep):
        self.per_minute, self.now, self.sleep = per_minute, now, sleep
        self.have, self.at = float(per_minute), now()

    def wait(self) -> None:
        at = self.now()
        self.have, self.at = min(self.per_minute, self.have + (at - self.at) * self.per_minute / 60), at
        if self.have < 1:
            self.sleep((1 - self.have) * 60 / self.per_minute)
            self.have, self.at = 1.0, self.now()
        self.have -= 1


def first_day(frame: Timeframe, lookback: int, end: datetime, hours: float) -> datetime:
    """Early enough for so many bars, weekends and holidays included. hours: of a trading day."""
    if not frame.is_intraday:
        return end - timedelta(days=int(lookback * 1.6) + 10)
    return end - timedelta(days=int(lookback / max(1, int(hours * 3600 // frame.seconds)) * 1.9) + 3)


@dataclass
class Symbols(InputPartition):
    symbols: list[str]


def _get(url: str, headers: dict) -> dict:
    with urlopen(Request(url, headers=headers), timeout=30) as answer:
        return json.load(answer)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        from ..app.config import secret

        self.vendor = options.get("vendor", "")
        if self.vendor not in ADDRESS:
            raise NotConfigured(f"vendor must be one of {', '.join(ADDRESS)}")
        self.frame, self.lookback = Timeframe.parse(options.get("timeframe", "1D")), int(options.get("lookback", 300))
        self.symbols = [s.strip().upper() for s in options.get("symbols", "").split(",") if s.strip()]
        self.feed, self.tier, self.base = options.get("feed", "iex"), options.get("tier", "free"), options.get("base", ADDRESS[self.vendor])
        self.end = datetime.fromisoformat(options["end"]).replace(tzinfo=timezone.utc) if "end" in options else datetime.now(timezone.utc)
        self.group = int(options.get("group", 50))
        names = ("ALPACA_KEY_ID", "ALPACA_SECRET") if self.vendor == "alpaca" else ("POLYGON_API_KEY",)
        self.keys = [secret(n, options.get("env_file", ".env")) for n in names]
        if not all(self.keys):
            raise NotConfigured(f"{self.vendor} needs {' and '.join(names)}")
        if self.feed not in ("iex", "sip") or self.tier not in ("free", "paid"):
            raise NotConfigured("feed is iex or sip, tier is free or paid")

    def capped(self) -> bool:
        return self.vendor == "polygon" and self.tier == "free"

    def partitions(self) -> list[Symbols]:
        size = len(self.symbols) if self.capped() else self.group
        return [Symbols(self.symbols[i : i + size]) for i in range(0, len(self.symbols), max(size, 1))] or [Symbols([])]

    def read(self, partition: Symbols) -> Iterator[tuple]:
        if self.vendor == "alpaca":
            yield from self.alpaca(partition.symbols)
        else:
            bucket = TokenBucket(FREE_CAP) if self.capped() else None
            for s in partition.symbols:
                yield from self.guarded([s], self.polygon(s, bucket))

    def guarded(self, symbols: list[str], rows: Iterator[tuple]) -> Iterator[tuple]:
        """rows, then an error row for each symbol without any; an interface that fails errs for all its symbols."""
        seen: set[str] = set()
        try:
            for r in rows:
                seen.add(r[0])
                yield r
            why = "no data returned"
        except HTTPError as e:
            if e.code in (401, 403):
                raise NotConfigured(f"{self.vendor} rejected the keys ({e.code})") from None
            why, seen = f"{self.vendor}: status {e.code}", set()
        except (URLError, TimeoutError, ValueError) as e:
            why, seen = f"{self.vendor}: {e}", set()
        for s in symbols:
            if s not in seen:
                yield (s, None, None, None, None, None, None, None, why)

    def alpaca(self, symbols: list[str]) -> Iterator[tuple]:
        if symbols:
            yield from self.guarded(symbols, self.alpaca_pages(symbols))

    def alpaca_pages(self, symbols: list[str]) -> Iterator[tuple]:
        start = first_day(self.frame, self.lookback, self.end, 6.5).strftime("%Y-%m-%dT%H:%M:%SZ")
        ask = {"symbols": ",".join(symbols), "timeframe": ALPACA_FRAMES[self.frame.value], "start": start, "limit": "10000", "adjustment": "split", "feed": self.feed}
        headers, page = {"APCA-API-KEY-ID": self.keys[0], "APCA-API-SECRET-KEY": self.keys[1], "Accept": "application/json"}, 0
        while True:
            answer = _get(f"{self.base}/v2/stocks/bars?{urlencode(ask)}", headers)
            for symbol, bars in (answer.get("bars") or {}).items():
                for b in bars:
                    yield (symbol, datetime.fromisoformat(b["t"].replace("Z", "+00:00")), *(float(b[k]) for k in "ohlcv"), page, None)
            if not answer.get("next_page_token"):
                return
            ask["page_token"], page = answer["next_page_token"], page + 1

    def polygon(self, symbol: str, bucket: TokenBucket | None) -> Iterator[tuple]:
        start = first_day(self.frame, self.lookback, self.end, 16)
        url = f"{self.base}/v2/aggs/ticker/{quote(symbol)}/range/{POLYGON_FRAMES[self.frame.value]}/{start:%Y-%m-%d}/{self.end:%Y-%m-%d}?" + urlencode({"adjusted": "true", "sort": "asc", "limit": "50000"})
        page = 0
        while url:
            if bucket:
                bucket.wait()
            answer = _get(url, {"Authorization": f"Bearer {self.keys[0]}"})
            for b in answer.get("results") or []:
                yield (symbol, datetime.fromtimestamp(b["t"] / 1000, timezone.utc), *(float(b[k]) for k in "ohlcv"), page, None)
            url, page = answer.get("next_url"), page + 1


class MarketBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarketBars)


def errors_of(raw: DataFrame) -> DataFrame:
    """symbol, error; a symbol that failed after some pages is an error, too."""
    return raw.filter(F.col("error").isNotNull()).select("symbol", "error").distinct()


def bars_of(raw: DataFrame, frame: Timeframe, now: datetime, lookback: int = 0, extended: bool = True, delay_seconds: int = 0) -> DataFrame:
    """The bar contract from rows read: of bars with equal times the one of the last page, sessions, completed bars only, the last lookback."""
    failed = errors_of(raw).select("symbol")
    rows = raw.filter(F.col("error").isNull()).join(failed, "symbol", "left_anti")
    best = rows.groupBy("symbol", "ts").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "page").alias("b")).select("symbol", "ts", "b.*")
    bars = tag_sessions(best, frame)
    bars = drop_incomplete(bars if extended else rth_only(bars), frame, now)
    return tail(trim_delay(bars, frame, now, delay_seconds) if delay_seconds else bars, lookback)
