"""The script language: syntax, semantics against literals, and scripts of our own against the native plans."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_engine import bars_of, column, recurse, walk

from tickframe.operators import window as w
from tickframe.plans.momentum import momentum
from tickframe.script.engine import last_values, prefix_of, script_engine, with_script
from tickframe.script.program import Run, analyse, resampled
from tickframe.script.syntax import ScriptRuntimeError, ScriptSyntaxError, ScriptUnsupportedError, slug


def bars(closes, step=timedelta(days=1), start=datetime(2026, 1, 5, 14, 30, tzinfo=timezone.utc), sessions=None):
    n = len(closes)
    up = [None if c is None else c + 1.0 for c in closes]
    down = [None if c is None else c - 1.0 for c in closes]
    return {"ts": [start + i * step for i in range(n)], "open": list(closes), "high": up, "low": down, "close": list(closes), "volume": [100.0 + i for i in range(n)], "session": sessions or ["rth"] * n}


def run(source, closes=(1.0, 2.0, 3.0, 2.0, 5.0), overrides=None, **more):
    p = analyse(source, overrides)
    r = Run(p, bars(closes, **more)).go()
    return {c.name: v for c, v in zip(p.columns, r.columns)}


def test_history_var_if_and_function():
    out = run(
        """
indicator("Long title", "Short one")
var int n = 0
var float best = na
if close > nz(close[1])
    n := n + 1
    best := close
else if close < close[1]
    n := n - 1
else
    n := 100
twice(float x) =>
    y = x * 2
    y + 1
one(x) => x + 1
plot(n, "N up")
plot(best, title = "Best")
plot(twice(close) - one(close), "Calc")
plot(close[2], "Two back")
"""
    )
    assert out["n_up"] == [1, 2, 3, 2, 3] and out["best"] == [1, 2, 3, 3, 5]
    assert out["calc"] == [1, 2, 3, 2, 5] and out["two_back"] == [None, None, 1, 2, 3]


def test_continued_lines_comments_and_ternary():
    out = run('x = close > 2 ? 1 :  // first\n     close > 1 ? 2 : na\nplot(x, "x")\nplot(1e2 + -close % 2 * 2, "y")\nplot(close / 0, "z")')
    assert out["x"] == [None, 2, 1, 2, 1] and out["y"] == [98, 100, 98, 100, 98] and out["z"] == [None] * 5


def test_missing_values():
    out = run('plot(ta.sma(close, 2), "s")\nplot(ta.ema(close, 2), "e")\nplotshape(close > 1 and true, "b")\nplotshape(close > 1, "c")\nplot(na(close) ? -1 : 0, "m")', (1.0, 3.0, None, 2.0, 4.0))
    assert out["s"] == [None, 2, None, None, 3] and out["e"] == [None, 2, None, None, 3]
    assert out["b"] == [False, True, False, True, True] and out["c"] == [False, True, None, True, True] and out["m"] == [0, 0, -1, 0, 0]


def test_state_of_call_sites():
    """An untaken if doesn't feed its windows, a ternary feeds both; each call of a function has its own state."""
    out = run(
        """
f(x) =>
    var float total = 0.0
    total := total + x
    total
a = f(close)
b = f(1)
s = na
if close >= 2
    s := math.sum(close, 2)
plot(a, "a")
plot(b, "b")
plot(s, "s")
plot(close >= 2 ? math.sum(close, 2) : 0, "t")
"""
    )
    assert out["a"] == [1, 3, 6, 8, 13] and out["b"] == [1, 2, 3, 4, 5]
    assert out["s"] == [None, None, 5, 5, 7] and out["t"] == [0, 3, 5, 5, 7]


def test_arrays_tuples_and_text():
    out = run(
        """
var array<float> q = array.new<float>()
array.push(q, close)
if array.size(q) > 2
    array.shift(q)
pair(x) => [x, x + 1]
[p, r] = pair(close)
plot(array.avg(q), "avg")
plot(array.get(q, 0), "first")
plot(array.sum(array.new<float>(3, 2)), "filled")
plot(array.pop(array.new<float>()), "none")
plot(r - p, "one")
t = "v" + str.tostring(close, "0.00")
plot(t == "v1.00" ? 1 : 0, "text")
"""
    )
    assert out["avg"] == [1, 1.5, 2.5, 2.5, 3.5] and out["first"] == [1, 1, 2, 3, 2] and out["one"] == [1] * 5
    assert out["filled"] == [6] * 5 and out["none"] == [None] * 5 and out["text"] == [1, 0, 0, 0, 0]


def test_library_against_loops():
    rng = random.Random(4)
    x = [round(100 + rng.gauss(0, 3), 1) for _ in range(80)]
    out = run(
        'plot(ta.percentrank(close, 10), "pr")\nplot(ta.median(close, 4), "med")\nplot(ta.highest(close, 5), "hi")\nplot(ta.rsi(close, 5), "rsi")\n'
        'plot(ta.atr(5), "atr")\nplotshape(ta.crossover(close, 100), "up")\nplot(ta.barssince(close > 100), "since")\nplot(ta.mom(close, 3), "mom")\nplot(math.round(2.5) + math.sign(-3) + math.max(1, 4), "m")',
        x,
    )
    d = [None, *(b - a for a, b in zip(x, x[1:]))]
    up, down = (recurse([None if v is None else max(s * v, 0.0) for v in d], 5, 1 / 5, "reset") for s in (1, -1))
    for i in range(80):
        assert out["pr"][i] == (None if i < 10 else pytest.approx(sum(v <= x[i] for v in x[i - 10 : i]) * 10))
        assert out["hi"][i] == (None if i < 4 else max(x[i - 4 : i + 1]))
        assert out["rsi"][i] == (None if i < 5 else pytest.approx(100 - 100 / (1 + up[i] / down[i])))
        assert out["up"][i] == (i > 0 and x[i] > 100 and x[i - 1] <= 100)
        assert out["mom"][i] == (None if i < 3 else pytest.approx(x[i] - x[i - 3]))
        before = [i - k for k in range(i + 1) if x[k] > 100]
        assert out["since"][i] == (min(before) if before else None)
    assert out["m"] == [5] * 80 and out["atr"][4] is not None and out["atr"][3] is None


def test_higher_timeframe():
    source = 'a = request.security(syminfo.tickerid, "60", close)\n[b, c] = request.security(syminfo.tickerid, "60", [close[1], ta.sma(close, 2)], lookahead = barmerge.lookahead_on)\nplot(a, "a")\nplot(b, "b")\nplot(c, "c")\nplot(request.security("", "", close), "d")'
    x = [float(i) for i in range(12)]
    out = run(source, x, step=timedelta(minutes=15))
    assert out["a"] == [None] * 4 + [3] * 4 + [7] * 4 == out["b"] and out["c"] == [None] * 4 + [5] * 4 + [9] * 4 and out["d"] == x
    days = bars([float(i) for i in range(21)])
    starts, weeks = resampled(days, "W")
    assert weeks["close"] == [6, 13, 20] and [s.astimezone(timezone.utc).hour for s in starts] == [5] * 3
    assert resampled(days, "2D")[1]["close"] == [1.0 + 2 * i for i in range(10)] + [20.0] and resampled(days, "M")[1]["volume"] == [sum(100.0 + i for i in range(21))]


def test_inputs():
    source = 'n = input.int(2, "Length")\ns = input.source(close, "Source")\nplot(ta.sma(s, n), "v")'
    assert run(source)["v"] == [None, 1.5, 2.5, 2.5, 3.5]
    assert run(source, overrides={"Length": 1, "Source": "high"})["v"] == [2, 3, 4, 3, 6]
    with pytest.raises(ScriptRuntimeError, match="Lenth"):
        run(source, overrides={"Lenth": 1})


def test_names():
    p = analyse('indicator("A – b", "")\nplot(close, "X • y")\nplot(open, "x y")\nplot(1)\nalertcondition(close > 1, "Go!")')
    assert [(c.name, c.kind) for c in p.columns] == [("x_y", "float"), ("x_y_2", "float"), ("plot_1", "float"), ("go", "bool")]
    assert prefix_of(p) == "a_b" and slug("•") == "col"


@pytest.mark.parametrize(
    "source, error, line",
    [
        ("x = 1\nfor i = 0 to 3\n    x := i", ScriptUnsupportedError, 2),
        ("plot(nope)", ScriptRuntimeError, 1),
        ("plot(close[-1])", ScriptUnsupportedError, 1),
        ("plot(close,", ScriptSyntaxError, 1),
        ("\nx := 2", ScriptRuntimeError, 2),
        ("plot(ta.vwap(close))", ScriptUnsupportedError, 1),
        ("plot(f(close))", ScriptRuntimeError, 1),
        ('plot(str.format("{0}", close))', ScriptUnsupportedError, 1),
        ("f(x) => f(x)\nplot(f(1))", ScriptUnsupportedError, 1),
        ('plot(close, str.tostring(close))', ScriptUnsupportedError, 1),
        ("a = 1 $ 2", ScriptSyntaxError, 1),
        ("f(x) =>\n    y = x\n    y[1]\nplot(f(close))", ScriptUnsupportedError, 3),
    ],
)
def test_errors_before_any_bar(source, error, line):
    with pytest.raises(error) as e:
        analyse(source)
    assert e.value.line == line


OURS = """
indicator("Our momentum", "om")
squash(x) =>
    e = math.exp(2 * math.max(-20, math.min(20, x)))
    (e - 1) / (e + 1)
move = close - close[10]
norm = ta.sma(math.abs(move), 50)
raw = norm > 0 ? move / norm : 0.0
score = ta.ema(50 * squash(raw / 2), 3)
plot(score, "score")
plot(score >= 30 ? 2 : score > 5 ? 1 : score <= -30 ? -2 : score < -5 ? -1 : 0, "state")
alertcondition(ta.crossover(score, 0), "up")
"""


def test_script_against_native_plan(spark):
    b = bars_of(spark, walk(160)).union(bars_of(spark, walk(160, 8), "B"))
    both = with_script(momentum(b), OURS).filter("ts >= '2026-01-10'").collect()
    assert len(both) == 310
    for r in both:
        assert r.om_score == pytest.approx(r.mb_score, abs=1e-9) and r.om_state == r.mb_state and r.om_up == r.mb_cross_zero_up


def test_script_as_engine_and_errors(spark, tmp_path):
    from tickframe.plans import scan as sc

    path = tmp_path / "Fast sma.pine"
    path.write_text('n = input.int(8, "Length")\nplot(ta.sma(close, n), "Value")')
    b = bars_of(spark, walk(300)).union(bars_of(spark, walk(200), "B"))
    request = sc.ScanRequest(engines=[sc.Engine(**script_engine(path, {"Length": 5}))], sort="fast_sma_value")
    out = sc.scan(b, request)
    want = column(bars_of(spark, walk(300)).withColumn("v", w.sma(F.col("close"), 5)), "v")[-1]
    assert [(r.symbol, r.fast_sma_value) for r in out.rows.collect()] == [("A", pytest.approx(want))]
    assert [r.symbol for r in out.errors.collect()] == ["B"]
    bad = with_script(b, 'plot(array.get(array.new<float>(), close), "x")', prefix="p", error="why")
    assert {(r.p_x, r.why) for r in last_values(bad, ["p_x", "why"]).collect()} == {(None, r.why) for r in bad.select("why").collect()}
    assert all("array" in r.why for r in bad.select("why").distinct().collect())
