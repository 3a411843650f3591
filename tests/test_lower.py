"""Lowered scripts against the bar-by-bar program, over bars with gaps; what is left to the island, and what the plans hold."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest

from tickframe.queries import SCRIPTS
from tickframe.script.engine import _bar_by_bar, with_script
from tickframe.script.lower import lowered
from tickframe.script.program import analyse

PYTHON = ("Arrow", "Python", "Pandas")


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    """Three symbols with missing values, gaps of days, and all sessions."""
    rng, rows = random.Random(8), []
    for k, n in enumerate((160, 90, 3)):
        x, ts = 100.0, datetime(2026, 1, 5, 13, 0, tzinfo=timezone.utc)
        for _ in range(n):
            ts += timedelta(minutes=rng.choice((15, 15, 15, 15, 60, 60 * 20)))
            x += rng.choice((-1, 0, 0.5, 1))
            o, h, low, c, v = x, x + rng.choice((0, 1)), x - 1, x + rng.choice((-1, 0, 0.5)), float(rng.randint(0, 9))
            row = [o, max(h, c), min(low, c), c, v]
            if rng.random() < 0.06:
                row[rng.randrange(5)] = None
            rows.append((f"s{k}", ts, *row, rng.choice(("pre", "rth", "rth", "post", None))))
    path = f"file://{tmp_path_factory.mktemp('bars')}/bars"
    spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, session string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def same(a, b):
    return a is None and b is None or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or type(a) is type(b) and a == b


def held_against_bars(bars, source, overrides=None):
    """The lowered script's columns are the bar-by-bar program's. Returns the lowering."""
    program = analyse(source, overrides)
    names = [f"x_{c.name}" for c in program.columns]
    want = _bar_by_bar(bars, program, names, None).select(*bars.columns, *names)
    got = with_script(bars, source, overrides, "x")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    for a, b in zip(rows_of(got), rows_of(want), strict=True):
        assert all(map(same, a, b)), (dict(zip(got.columns, a)), dict(zip(got.columns, b)))
    return lowered(program)


WHOLE = {
    "windows": 'plot(ta.sma(close, 3), "a")\nplot(ta.stdev(high - low, 4), "b")\nplot(ta.median(close, 5), "c")\nplot(ta.highest(high, 4) - ta.lowest(low, 4), "d")\nplot(math.sum(volume, 3), "e")\nplot(ta.percentrank(close, 6), "f")',
    "nested": 'plot(ta.sma(ta.sma(close, 2) - ta.highest(open, 3), 2), "a")\nx = ta.change(close, 2)\nplot(x - x[3], "b")\nplot(ta.mom(x, 1), "c")\nplot(close[1] > close ? ta.sma(x, 3) : na, "d")',
    "recursions": 'plot(ta.ema(close, 5), "a")\nplot(ta.rma(ta.ema(close, 3), 4), "b")\nplot(ta.rsi(close, 5), "c")\nplot(ta.atr(4), "d")\nplot(ta.sma(ta.rsi(close, 3), 4), "e")\nplot(ta.ema(close, 1), "f")',
    "conditions": 'f = ta.sma(close, 3)\nplotshape(ta.crossover(close, f), "a")\nplotshape(ta.crossunder(close, 100), "b")\nplot(ta.barssince(close > f), "c")\nplotshape(not (close > f), "d")\nplotshape(close > f and volume, "e")\nplotshape(close or na, "f")\nalertcondition(close > open, "g")\nplotshape(close == open, "h")\nplotshape(close != open ? na : close > 1, "i")',
    "mathematics": 'plot(math.max(close, open, 99) + math.min(low, 100), "a")\nplot(math.sqrt(close - 100), "b")\nplot(math.log(close - 100), "c")\nplot(math.pow(close - 100, 3), "d")\nplot(math.round(close / 3) + math.sign(open - close), "e")\nplot(math.avg(open, close, low), "f")\nplot(close / (open - close) + close % (open - close), "g")\nplot(math.tanh(close - 100) * math.exp(close), "h")\nplot(nz(close) + nz(open, -5), "i")\nplot(na(close) ? -1 : math.floor(close) - math.ceil(open), "j")\nplot(-close + 1e1, "k")',
    "context": 'plot(bar_index, "a")\nplotshape(barstate.isfirst or barstate.islast, "b")\nplotshape(session.ismarket, "c")\nplot(hl2 + hlc3 - ohlc4, "d")\nplotshape(barstate.isconfirmed, "e")\nplot(bar_index[2], "f")',
    "branches": 'x = na\nif close > open\n    x := close\n    plot(x, "up")\nelse if close < open\n    x := -open\n    y = 2\n    x := x * y\nelse\n    z = high\n    plot(z, "flat")\nplot(x, "x")\nif na(x)\n    x := 5\nplot(x, "later")\nplot(x[1], "before")',
    "functions": 'g = 3\nspread(a, b) => a - b\nboth(float x, n) =>\n    m = ta.sma(x, n)\n    k = 0\n    if x > m\n        k := 1\n    [m, k, x - m]\n[p, q, r] = both(close, 3)\n[s, t, u] = both(open, g)\nplot(p + spread(q, r), "a")\nplot(t, "b")\nplot(u[1], "c")',
    "inputs": 'n = input.int(4, "Length")\nsrc = input.source(hl2, "Source")\nmode = input.string("a", "Mode", options = ["a", "b"])\non = input.bool(true, "On")\nplot(mode == "a" ? ta.sma(src, n) : ta.highest(src, n), "v")\nplot(on ? close : open, "w")\nplot(close, color = color.red)\nhline(5)\nvar label l = na',
    "kept vars": 'var float last = na\nif close > open\n    last := close\nplot(last, "last")\nplot(last[1], "before")\nvar bool above = false\nif close > 101\n    above := true\nelse if close < 99\n    above := false\nplotshape(above, "above")\nvar int c = 7\nplot(c, "c")\nvar float m = 1\nm := close\nplot(m, "m")',
    "counting vars": 'var int n = 0\nn := n + 1\nplot(n, "n")\nvar int run = 5\nrun := close > open ? 0 : run + 1\nplot(run, "run")\nvar float sum = 0\nif close > open\n    sum := sum + volume\nelse if volume > 6\n    sum := volume\nplot(sum, "sum")\nvar int d = 0\nif volume > 4\n    d := 1 + d\nelse\n    d := d - 2\nplot(d - d[1], "d")',
    "higher": 'a = request.security(syminfo.tickerid, "60", close)\n[b, c] = request.security(syminfo.tickerid, "240", [close[1], ta.sma(close, 2)], lookahead = barmerge.lookahead_on)\nf(x) => ta.ema(x, 2)\nlen = 2\nm = ta.highest(high, len)\nplot(a, "a")\nplot(b, "b")\nplot(c, "c")\nplot(request.security("", "D", f(close) + m), "d")\nplotshape(request.security("", "W", close > open, lookahead = barmerge.lookahead_on), "w")\nplot(request.security("", "M", volume), "m")\nplot(request.security("", "2D", ta.rsi(close, 2)), "2d")\nplot(request.security("", "", close), "own")',
}
#: Scripts of which a part is left, and how many statements that is.
MIXED = {
    "array": ('s = ta.sma(close, 3)\nvar array<float> q = array.new<float>()\narray.push(q, s)\nif array.size(q) > 4\n    array.shift(q)\navg = array.avg(q)\nd = avg - s\nplot(ta.sma(d, 2), "d")\nplot(ta.ema(close, 3), "e")\nplotshape(ta.crossover(avg, s), "x")', 4),
    "branch with state": ('x = na\nif close > open\n    x := ta.sma(close, 2)\nplot(x, "x")\nplot(ta.highest(x, 2), "h")\ny = close * 2\nplot(y, "y")', 2),
    "recursive var": ('var float y = 0\ny := y * 0.5 + ta.sma(close, 2)\nplot(y, "y")\nplot(y[1] - y, "d")\nk = 3\nplot(ta.sma(y, k), "m")', 2),
    "function var": ('f(x) =>\n    var float t = 0.0\n    t := t + nz(x)\n    t\nc = ta.change(close)\nt = f(c)\nplot(t, "t")\nplot(ta.sma(c, 3), "c")', 1),
    "varying history": ('n = close > open ? 1 : 2\nb = close[n]\nplot(b, "b")\nplot(ta.sma(close, n > 5 ? 2 : 2), "c")', 2),
    "history of a later value": ('x = na\nif close > open\n    x := close\nplot(x[1], "before")\nif na(x)\n    x := 5\nplot(x, "later")\nplot(ta.sma(close, 2), "s")', 4),
    "in between": ('var float y = 1\ny := y * 2 > 100 ? 1 : y * 2\nz = y + close\nvar float w = 0\nw := w * 0.5 + nz(z)\nplot(w + z, "w")', 5),
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_scripts(bars, name):
    low = held_against_bars(bars, WHOLE[name])
    assert low is not None and not low.island


@pytest.mark.parametrize("name", MIXED)
def test_mixed_scripts(bars, name):
    source, left = MIXED[name]
    low = held_against_bars(bars, source)
    assert low is not None and len(low.island) == left


def test_overrides(bars):
    held_against_bars(bars, WHOLE["inputs"], {"Length": 2, "Source": "low", "Mode": "b", "On": False})


def test_plans(bars):
    """Scripts of windows and recursions have no Python, and one exchange for all windows; a mixed script has one island."""
    for name in SCRIPTS:
        plan = with_script(bars, SCRIPTS[name], prefix="x")._jdf.queryExecution().executedPlan().toString()
        assert not any(k in plan for k in PYTHON) and plan.count("Exchange") == 1, name
    mixed = with_script(bars, MIXED["array"][0], prefix="x")._jdf.queryExecution().optimizedPlan().toString()
    assert mixed.count("FlatMapGroupsInArrow") == 1


def test_errors_of_the_island(bars):
    source = 'var a = array.new<float>()\nif close > 100\n    array.push(a, close)\nplot(array.get(a, 0), "first")\nplot(ta.sma(close, 2), "s")'
    out = with_script(bars.filter("symbol <> 's2'"), source, prefix="x", error="wrong").collect()
    assert any(r.wrong for r in out) and all(r.x_s is None and r.x_first is None for r in out if r.wrong)
