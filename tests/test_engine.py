"""Primitives against literals, plans against loops, the filter language, sessions, and the scan's edges."""

import math
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickframe.functions.sessions import drop_incomplete, tag_sessions
from tickframe.operators import recursive as rec
from tickframe.operators import window as w
from tickframe.plans import flow
from tickframe.plans import scan as sc
from tickframe.plans.momentum import momentum
from tickframe.plans.regime import regime
from tickframe.predicate import FilterError, apply_filter
from tickframe.sources import bars as sources
from tickframe.schema import BAR_SCHEMA, BarError, validate
from tickframe.timeframe import Timeframe


def bars_of(spark, closes, symbol="A"):
    start = datetime(2026, 1, 5)
    rows = [(symbol, start + timedelta(days=i), c, None if c is None else c + 1.0, None if c is None else c - 1.0, c, 100.0 + i, "rth") for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR_SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("ts").select(name).collect()]


def walk(n, seed=3):
    rng = random.Random(seed)
    x, out = 100.0, []
    for _ in range(n):
        x += rng.gauss(0.05, 1)
        out.append(x)
    return out


def test_windows(spark):
    b = bars_of(spark, [1.0, 2.0, 3.0, 2.0, 5.0])
    x = F.col("close")
    out = b.withColumns({"sma": w.sma(x, 3), "sd": w.stdev_pop(x, 2), "e": w.before(x, 2), "med": w.rolling_median(x, 3), "up": w.crossover(x, F.lit(2.5), F.lit(2.5))})
    out = out.withColumn("pr", w.share_at_most(F.col("e"), x, 2))
    assert column(out, "sma") == [None, None, 2.0, pytest.approx(7 / 3), pytest.approx(10 / 3)]
    assert column(out, "sd") == [None, 0.5, 0.5, 0.5, 1.5]
    assert column(out, "pr") == [None, None, 100.0, 50.0, 100.0]
    assert column(out, "med") == [None, None, 2.0, 2.0, 3.0]
    assert column(out, "up") == [False, False, True, False, True]


def test_window_with_gap(spark):
    out = bars_of(spark, [1.0, None, 3.0, 4.0]).withColumn("s", w.sma(F.col("close"), 2))
    assert column(out, "s") == [None, None, None, 3.5]


def recurse(values, n, alpha, on_gap="skip"):
    """Value by value."""
    out, y, seen, total = [], None, 0, 0.0
    for x in values:
        if x is None:
            if on_gap == "reset":
                y, seen, total = None, 0, 0.0
            out.append(None)
            continue
        if y is None:
            seen, total = seen + 1, total + x
            y = total / n if seen == n else None
        else:
            y = alpha * x + (1 - alpha) * y
        out.append(y)
    return out


def test_recursion_and_gap_rules(spark):
    made = lambda closes, *spec: column(rec.with_recursions(bars_of(spark, closes), rec.Recursion("y", "close", *spec)), "y")
    assert made([1.0, 2.0, 3.0, 4.0], 2, 2 / 3) == [None, 1.5, pytest.approx(2.5), pytest.approx(3.5)]
    assert made([1.0, None, 3.0, 5.0], 2, 0.5) == [None, None, 2.0, 3.5]
    assert made([1.0, 2.0, None, 3.0, 5.0], 2, 0.5, "reset") == [None, 1.5, None, None, 4.0]


@pytest.mark.parametrize("gaps", [0.0, 0.02, 0.5, 1.0])
def test_recursions_over_many_blocks(spark, gaps):
    """Against the loop: fast and slow ones, seeds and gaps anywhere, one reading another; no Python and one exchange in the plan."""
    rng = random.Random(3)
    closes = [None if rng.random() < gaps else 100 + 50 * math.sin(i / 40) + rng.gauss(0, 5) for i in range(3000)]
    closes[700:1400] = [0.0 if c is not None else None for c in closes[700:1400]]
    specs = [f(f"{f.__name__}{n}{gap}", "close", n, gap) for f in (rec.ema, rec.rma) for n in (1, 2, 5, 14, 200) for gap in ("skip", "reset")]
    out = rec.with_recursions(bars_of(spark, closes), *specs, rec.ema("twice", "rma5skip", 3))
    rows = out.orderBy("ts").collect()
    for name, want in [(s.out, recurse(closes, s.n, s.alpha, s.on_gap)) for s in specs] + [("twice", recurse([r.rma5skip for r in rows], 3, 0.5))]:
        got = [r[name] for r in rows]
        assert [x is None for x in got] == [x is None for x in want], name
        assert all(math.isclose(a, b, rel_tol=1e-10, abs_tol=1e-10) for a, b in zip(got, want) if a is not None), name
    lengths = rec.block_lengths({2 / 3, 0.5, 1 / 3, 1 / 14, 0.001, 1.0})
    assert 1.0 not in lengths and all(n * -math.log1p(-a) >= rec.LEAST for a, n in lengths.items()) and lengths[0.001] > lengths[1 / 14] > lengths[2 / 3]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


@pytest.mark.parametrize("on_gap", ["skip", "reset"])
def test_last_steps_by_definition(spark, on_gap):
    """Over ranks (whole numbers), the value is the loop's to the last digit, so that ties of two sides fall as they do there."""
    rng = random.Random(8)
    ranks = [None] * 5 + [None if rng.random() < 0.01 else float(rng.randint(0, 100)) for _ in range(2000)]
    got = column(rec.with_recursions(bars_of(spark, ranks), rec.ema("y", "close", 5, on_gap, steps=rec.exact_steps(1 / 3))), "y")
    assert got == recurse(ranks, 5, 2 / 6, on_gap)


def test_independent_sides_take_exact_steps():
    specs, _ = flow.recursions(flow.Flow(scale_mode="independent"))
    assert [s.steps for s in specs] == [60, 60, 1, 1] and {s.steps for s in flow.recursions(flow.Flow())[0]} == {1}


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """One exchange by symbol, of a bounded number of rows a task, and the same bars."""
    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("no test tables")
    plain = rec.with_atr(sources.daily_from_lineitem(spark, "/root/testdata/sf0.001"), "atr", 14)
    monkeypatch.setattr(sources, "ROWS_A_TASK", 500)
    many = rec.with_atr(sources.daily_from_lineitem(spark, "/root/testdata/sf0.001"), "atr", 14)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert many.rdd.getNumPartitions() >= 12 > 4 >= plain.rdd.getNumPartitions()
    assert sorted(many.collect()) == sorted(plain.collect())


def test_rsi_edges(spark):
    for closes, last in (([float(i) for i in range(20)], 100.0), ([float(-i) for i in range(20)], 0.0), ([5.0] * 20, 100.0)):
        values = column(rec.with_rsi(bars_of(spark, closes), "rsi", "close", 14), "rsi")
        assert values[-1] == last and values[13] is None and values[14] is not None


def test_momentum_against_loop(spark):
    closes = walk(150)
    got = column(momentum(bars_of(spark, closes)), "mb_score")
    import math

    raw = []
    for i in range(150):
        m = [abs(closes[k] - closes[k - 10]) for k in range(max(10, i - 49), i + 1)]
        raw.append((closes[i] - closes[i - 10]) / (sum(m) / 50) if len(m) == 50 and sum(m) > 0 else 0.0)
    want = recurse([50 * math.tanh(r / 2) for r in raw], 3, 0.5)
    assert got == pytest.approx(want, nan_ok=True)


def test_regime_state_and_counter(spark):
    out = regime(bars_of(spark, walk(120, 9)))
    states, since = column(out, "ggr_state"), column(out, "ggr_bars_since_flip")
    assert set(states) <= {-3, -2, -1, 0, 1, 2, 3} and since[0] == 0
    for i in range(1, 120):
        same = (states[i] > 0) - (states[i] < 0) == (states[i - 1] > 0) - (states[i - 1] < 0)
        assert since[i] == (since[i - 1] + 1 if same else 0)


def test_sessions_and_completeness(spark):
    stamps = ["2026-06-01 13:29:00", "2026-06-01 13:30:00", "2026-06-01 19:59:00", "2026-06-01 20:00:00"]
    df = spark.createDataFrame([("A", datetime.fromisoformat(t)) for t in stamps], "symbol string, ts timestamp")
    assert column(tag_sessions(df, Timeframe.M5), "session") == ["pre", "rth", "rth", "post"]
    assert column(drop_incomplete(df, Timeframe.M5, datetime(2026, 6, 1, 20, 3)), "ts")[-1] == datetime(2026, 6, 1, 19, 59)
    assert len(column(drop_incomplete(df, Timeframe.M5, datetime(2026, 6, 1, 20, 5)), "ts")) == 4


def test_timeframe():
    assert Timeframe.parse("Daily") is Timeframe.D1 and Timeframe.parse("60M") is Timeframe.H1
    with pytest.raises(ValueError):
        Timeframe.parse("2h")


def test_filter_language(spark):
    df = spark.createDataFrame([("A", 1, 2.5, True), ("B", -1, None, False), ("C", 3, 9.0, None)], "symbol string, state int, x double, ok boolean")
    names = lambda text: [r.symbol for r in apply_filter(df, text).orderBy("symbol").collect()]
    assert names("state > 0 and x > 2") == ["A", "C"]
    assert names("x != 2.5") == ["B", "C"] and names("not (x > 5)") == ["A", "B"]
    assert names("0 < state <= 1") == ["A"] and names("state in [3, -1]") == ["B", "C"] and names("state not in [3]") == ["A", "B"]
    assert names("ok") == ["A"] and names("abs(state) ** 2 > 8 | ok") == ["A", "C"] and names("") == ["A", "B", "C"]
    for bad in ("nope > 1", "x.real > 1", "__import__('os')", "@x > 1", "`x` > 1", "x >", "x", "symbol == 'A'"):
        with pytest.raises(FilterError):
            apply_filter(df, bad)


def test_scan_short_and_missing(spark):
    bars = bars_of(spark, walk(160)).union(bars_of(spark, walk(50), "B"))
    watch = spark.createDataFrame([("A",), ("B",), ("Z",)], "symbol string")
    out = sc.scan(bars, sc.ScanRequest(), watch)
    assert [r.symbol for r in out.rows.select("symbol").collect()] == ["A"]
    assert {r.symbol for r in out.errors.collect()} == {"B", "Z"}
    assert {"composite", "signal", "mb_score", "ggr_state", "sf_inst_bias"} <= set(out.rows.columns)


def test_validate(spark):
    bars = bars_of(spark, [1.0, 2.0])
    assert validate(bars) is bars
    with pytest.raises(BarError):
        validate(bars.withColumn("session", F.lit("night")))
    with pytest.raises(BarError):
        validate(bars.drop("volume"))


@pytest.mark.parametrize("gaps", [False, True])
def test_recursions_of_bounded_series_need_no_blocks(spark, gaps):
    closes = [None if gaps and i % 7 == 3 else c for i, c in enumerate(walk(300))]
    specs = rec.ema("fast", "close", 3), rec.rma("slow", "close", 14)
    out = rec.with_recursions(bars_of(spark, closes), *specs, longest=300)
    assert "__b0_" not in out._jdf.queryExecution().analyzed().toString()
    for s in specs:
        assert column(out, s.out) == pytest.approx(recurse(closes, s.n, s.alpha), abs=1e-9, nan_ok=True)
    assert not rec.unbroken(specs[0], 5000)


def test_scan_makes_its_bars_once(spark, tmp_path):
    bars_of(spark, walk(200)).union(bars_of(spark, walk(40), "B")).write.parquet(f"{tmp_path}/bars")
    table = sc.scan_table(spark.read.parquet(f"{tmp_path}/bars"))
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    rows = {r["symbol"]: r for r in table.collect()}
    assert rows["A"]["error"] is None and rows["A"]["composite"] is not None
    short = rows["B"]
    assert short["error"].startswith("only 40 bars") and short["last_price"] is not None
    assert [short[c] for c in table.columns if c.startswith(("mb_", "ggr_", "sf_"))] == [None] * sum(c.startswith(("mb_", "ggr_", "sf_")) for c in table.columns)
