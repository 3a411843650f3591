"""Timeframes: parsing, length, and the bucket a bar falls into."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


class Timeframe(Enum):
    M1, M5, M15, H1, D1 = "1m", "5m", "15m", "1h", "1D"

    @property
    def seconds(self) -> int:
        return {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "1D": 86400}[self.value]

    @property
    def is_intraday(self) -> bool:
        return self is not Timeframe.D1

    @classmethod
    def parse(cls, text: str) -> Timeframe:
        """Case is ignored; 1d, d, day, daily, 60m, h and hour are other names."""
        t = text.strip().lower()
        other = dict.fromkeys(("1d", "d", "day", "daily"), "1D") | dict.fromkeys(("60m", "h", "hour"), "1h")
        try:
            return cls(other.get(t, t))
        except ValueError:
            raise ValueError(f"unknown timeframe {text!r}; known: {', '.join(x.value for x in cls)}") from None


def eastern(ts: Column) -> Column:
    """Wall clock in New York of a UTC instant."""
    return F.from_utc_timestamp(ts, EASTERN)


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the UTC-aligned bucket of so many seconds."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def session_bucket(ts: Column, seconds: int, first: Column) -> Column:
    """Start of the bucket counted in absolute seconds from 09:30 Eastern on the day of `first`, the symbol's first bar."""
    midnight = F.to_utc_timestamp(F.date_trunc("day", eastern(first)), EASTERN)
    anchor = F.unix_timestamp(midnight) + F.lit(9 * 3600 + 1800)
    return F.timestamp_seconds(anchor + F.floor((F.unix_timestamp(ts) - anchor) / seconds) * seconds)
