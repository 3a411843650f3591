"""What a call site of a script remembers from bar to bar. Each has step(*values of this bar) -> value; None is missing."""

from __future__ import annotations

import statistics
from collections import deque
from functools import reduce
from math import sqrt
from operator import add


class Rolling:
    """A function of the last n values, none of them missing."""

    def __init__(self, n: int, f):
        self.last, self.n, self.f = deque(maxlen=max(n, 1)), max(n, 1), f

    def step(self, x):
        self.last.append(x)
        return None if len(self.last) < self.n or None in self.last else self.f(self.last)


def mean(xs):
    """Added in order, each sum rounded: sum() would carry the rounding along."""
    return reduce(add, xs) / len(xs)


def deviation(xs):
    m = mean(xs)
    return sqrt(sum((x - m) ** 2 for x in xs) / len(xs))


ROLLING = {"ta.sma": mean, "ta.stdev": deviation, "ta.median": statistics.median, "ta.highest": max, "ta.lowest": min, "math.sum": sum}


class PercentRank:
    """Percentage of the n values before that are at most this one."""

    def __init__(self, n: int):
        self.n, self.last = n, deque(maxlen=max(n, 1))

    def step(self, x):
        ready = x is not None and len(self.last) == self.n and None not in self.last
        out = 100.0 * sum(v <= x for v in self.last) / self.n if ready else None
        self.last.append(x)
        return out


class Smooth:
    """Seeded with the mean of n values; a missing one starts the seeding again."""

    def __init__(self, n: int, alpha: float):
        self.n, self.alpha, self.y, self.seed = max(n, 1), alpha, None, []

    def step(self, x):
        if x is None:
            self.y, self.seed = None, []
        elif self.y is not None:
            self.y = self.alpha * x + (1 - self.alpha) * self.y
        else:
            self.seed.append(x)
            if len(self.seed) == self.n:
                self.y = mean(self.seed)
        return self.y


def ema(n: int) -> Smooth:
    return Smooth(n, 2 / (n + 1))


def rma(n: int) -> Smooth:
    return Smooth(n, 1 / max(n, 1))


class Change:
    def __init__(self, n: int):
        self.last = deque(maxlen=n + 1)

    def step(self, x):
        self.last.append(x)
        old = self.last[0] if len(self.last) == self.last.maxlen else None
        return None if x is None or old is None else x - old


class Rsi:
    def __init__(self, n: int):
        self.change, self.up, self.down = Change(1), rma(n), rma(n)

    def step(self, x):
        d = self.change.step(x)
        up, down = self.up.step(None if d is None else max(d, 0.0)), self.down.step(None if d is None else max(-d, 0.0))
        if up is None:
            return None
        return 100.0 if down == 0 else 0.0 if up == 0 else 100.0 - 100.0 / (1.0 + up / down)


class Atr:
    def __init__(self, n: int):
        self.prev, self.smooth = None, rma(n)

    def step(self, high, low, close):
        if high is None or low is None:
            tr = None
        else:
            tr = high - low if self.prev is None else max(high - low, abs(high - self.prev), abs(low - self.prev))
        self.prev = close
        return self.smooth.step(tr)


class Cross:
    def __init__(self, sign: int):
        self.sign, self.before = sign, None

    def step(self, a, b):
        d = None if a is None or b is None else (a > b) - (a < b)
        out = d == self.sign and self.before is not None and self.before * self.sign <= 0
        self.before = d
        return out


class BarsSince:
    def __init__(self):
        self.n = None

    def step(self, held):
        self.n = 0.0 if held else None if self.n is None else self.n + 1
        return self.n
