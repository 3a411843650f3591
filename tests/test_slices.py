"""Windows, carries and recursions over slices of time against those by symbol."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickframe.operators import recursive as rec
from tickframe.operators import slices as s
from tickframe.operators import window as w

DAY = 86400


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    """One symbol of many bars with pauses and gaps, and two short ones."""
    rng, rows = random.Random(4), []
    for symbol, n in (("A", 2500), ("B", 7), ("C", 1)):
        ts, x = datetime(2026, 1, 1), 100.0
        for _ in range(n):
            ts += timedelta(minutes=rng.choice((30, 30, 30, 60, 60 * 24 * 3)) if rng.random() < 0.2 else 30)
            x += rng.gauss(0, 1)
            rows.append((symbol, ts, None if rng.random() < 0.03 else x, rng.random() < 0.02))
    path = f"file://{tmp_path_factory.mktemp('slices')}/bars"
    spark.createDataFrame(rows, "symbol string, ts timestamp, close double, flag boolean").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-10, abs_tol=1e-9)


def same(got, want):
    assert got.columns == want.columns
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(map(close, x, y)), (x, y)


def windows(df):
    x = F.col("close")
    df = df.withColumns({"m": w.sma(x, 8), "d": w.stdev_pop(x, 20), "h": w.highest(x, 5), "c": w.change(x, 10), "p": w.percent_rank(x, 15), "q": w.rolling_median(x, 9)})
    return df.withColumns({"up": w.crossover(x, F.col("m")), "m2": w.sma(F.col("m"), 6)})


@pytest.mark.parametrize("seconds", [DAY // 4, DAY * 2, DAY * 1000])
def test_bounded_windows(bars, seconds):
    """Slices of a few bars (a halo reaches over many), of a day or two, and of all."""
    same(s.bounded(bars, seconds, 20, windows), windows(bars))


@pytest.mark.parametrize("seconds", [DAY // 4, DAY * 3])
def test_carries(bars, seconds):
    at = bars.withColumn("n", w.bar_number())
    want = at.withColumns({"f": w.ffill(F.when(F.col("flag"), F.col("close"))), "since": w.bars_since(F.col("flag"), F.col("n"))}).select(*bars.columns, "f", "since", "n")
    got = s.with_carries(bars.withColumn("marked", F.when(F.col("flag"), F.col("close"))), seconds, {"f": "marked"}, "n", {"since": "flag"})
    same(got.drop("marked"), want)


@pytest.mark.parametrize(("n", "seconds"), [(3, DAY // 4), (14, DAY), (200, DAY * 5), (1, DAY), (5000, DAY)])
def test_recursions(bars, n, seconds):
    for spec in (rec.ema("y", "close", n), rec.rma("y", "close", n)):
        same(s.with_recursion(bars, seconds, spec), rec.with_recursions(bars, spec))


def test_one_symbol_in_several_tasks(spark, bars):
    one = bars.filter("symbol = 'A'")
    made = s.bounded(one, s.seconds_for(one, 200), 19, windows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        used, plain = (df.select("m2", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("m2")).collect() for df in (made, windows(one)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(used) == 4 and len(plain) == 1
    same(made, windows(one))


def test_reset_is_refused(bars):
    with pytest.raises(ValueError):
        s.with_recursion(bars, DAY, rec.ema("y", "close", 3, "reset"))


def test_bars_are_dealt_by_slice_only(bars):
    """The seed comes with the slices' counts: no join of bars by symbol alone, and bars that come in slices keep them."""
    spec = rec.rma("y", "close", 14)
    got = s.with_recursion(s.with_slices(bars, DAY), DAY, spec)
    assert not re.findall(r"Join \w+, \(symbol#\d+ = symbol#\d+\)", got._jdf.queryExecution().optimizedPlan().toString())
    assert s.SLICE in got.columns
    same(got.drop(s.SLICE), rec.with_recursions(bars, spec))
