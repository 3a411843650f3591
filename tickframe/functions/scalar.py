"""Scalar helpers with the engine's NULL rules: missing is NULL, and an unknown comparison is false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least composite of each signal tier.
TIERS = ((80.0, "Strong Buy"), (68.0, "Buy"), (50.0, "Watch"), (45.0, "Neutral"))
LOWEST_TIER = "Avoid"


def sure(condition: Column) -> Column:
    """The condition, false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def guarded_ratio(num: Column, denom: Column, otherwise: float | None) -> Column:
    """num / denom where denom > 0, else the fallback (also where denom is unknown)."""
    return F.when(denom > 0, num / denom).otherwise(F.lit(otherwise).cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ladder(*steps: tuple[Column, object], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    first, *rest = steps
    return reduce(lambda c, s: c.when(s[0], F.lit(s[1])), rest, F.when(first[0], F.lit(first[1]))).otherwise(F.lit(otherwise))


def compare(a: Column, b: Column) -> Column:
    """1, -1 or 0; 0 where unknown."""
    return ladder((a > b, 1), (a < b, -1), otherwise=0)


def half_even(x: Column, digits: int = 1) -> Column:
    """Rounded with ties to the even digit."""
    return F.rint(x * 10**digits) / 10**digits


def signal_tier(composite: Column) -> Column:
    return F.when(composite.isNotNull(), ladder(*((composite >= at, name) for at, name in TIERS), otherwise=LOWEST_TIER))
