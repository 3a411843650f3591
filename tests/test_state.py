"""Versioned tables: changes by key, batches that come twice, lost and late writers, and the dashboard's tables over scans."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_engine import bars_of, walk

from tickframe.plans import scan as sc
from tickframe.predicate import FilterError
from tickframe.state.dashboard import Dashboard
from tickframe.state.versioned import KEPT, POINTER, Conflict, Versioned

SCHEMA = "k string, v int"


@pytest.fixture
def table(spark, tmp_path):
    return Versioned(spark, f"file://{tmp_path}/t", SCHEMA, ("k",))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def folders(table, tmp_path):
    return sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir())


def test_changes_by_key(spark, table, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert rows_of(table.read()) == []
    table.upsert(df(("a", 1), ("b", 2)))
    before = table.read()
    table.upsert(df(("b", 3), ("c", 4), ("c", 4)))
    assert rows_of(table.read()) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows_of(before) == [("a", 1), ("b", 2)]  # a reader keeps what it began with
    table.toggle(df(("a", 9), ("d", 5)))
    assert rows_of(table.read()) == [("b", 3), ("c", 4), ("d", 5)]
    table.delete(spark.createDataFrame([("b",), ("z",)], "k string"))
    assert rows_of(table.read()) == [("c", 4), ("d", 5)]
    assert len(folders(table, tmp_path)) == KEPT and table.pointer()["number"] == 4


def test_batches_count_once(spark, table):
    df = lambda n: spark.createDataFrame([("n", n)], SCHEMA)
    assert table.push(df(1), "v", 3, batch=0) and table.push(df(2), "v", 3, batch=1)
    assert not table.push(df(99), "v", 3, batch=1) and not table.push(df(99), "v", 3, batch=0)
    for n in (3, 4, 5):
        assert table.push(df(n), "v", 3, batch=n)
    assert rows_of(table.read()) == [("n", 3), ("n", 4), ("n", 5)]


def test_lost_and_late_writers(spark, table, tmp_path, monkeypatch):
    table.upsert(spark.createDataFrame([("a", 1)], SCHEMA))
    with monkeypatch.context() as m:  # lost between writing its version and moving the pointer
        m.setattr(Versioned, "_move", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.upsert(spark.createDataFrame([("a", 2)], SCHEMA))
    assert rows_of(table.read()) == [("a", 1)] and len(folders(table, tmp_path)) == 2
    other = Versioned(spark, table.path, SCHEMA, ("k",))

    def late(old):
        other.upsert(spark.createDataFrame([("b", 7)], SCHEMA))
        return old

    with pytest.raises(Conflict):
        table.change(late)
    assert rows_of(table.read()) == [("a", 1), ("b", 7)]
    table.delete(spark.createDataFrame([("a",)], "k string"))
    assert rows_of(table.read()) == [("b", 7)] and len(folders(table, tmp_path)) == KEPT
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(f".{POINTER}-") and not p.name.endswith(".crc")]


def test_dashboard(spark, tmp_path):
    bars = bars_of(spark, walk(160)).union(bars_of(spark, walk(150, 5), "B")).union(bars_of(spark, walk(20), "S"))
    d, start = Dashboard(spark, f"file://{tmp_path}/d"), datetime(2026, 6, 1)
    momentum = sc.ScanRequest(engines=sc.builtin_engines())
    result = sc.scan(bars, momentum)
    for k in range(14):
        d.store(result, start + timedelta(minutes=k), batch=k) if k in (0, 13) else d.history.push(
            spark.createDataFrame([("scan", start + timedelta(minutes=k), 1.0, 2.0)], d.history.schema), "as_of", 12, batch=k
        )
    d.store(result, start + timedelta(days=9), batch=13)  # given again
    result.release()
    times = [r.as_of for r in d.history.read().orderBy("as_of").collect()]
    assert len(times) == 12 and times[-1] == start + timedelta(minutes=13)
    assert rows_of(d.rows().select("symbol")) == [("A",), ("B",)] and rows_of(d.errors.read().select("symbol")) == [("S",)]
    assert d.rows("mb_score > 1000").count() == 0 and d.overview().first().universe == 2
    with pytest.raises(FilterError):
        d.rows("nope > 1")
    for symbol in ("b", "z", "z", "q"):
        d.star(symbol)
    again = Dashboard(spark, f"file://{tmp_path}/d")
    assert rows_of(again.starred().select("symbol", F.col("last_price").isNotNull())) == [("B", True), ("Q", False)]
    again.save_scan("one", "mb_score > 0")
    again.save_scan("two", limit=5)
    again.save_scan("one", "mb_score > 1")
    again.delete_scan("two")
    assert rows_of(d.saved.read().select("name", "filter")) == [("one", "mb_score > 1")]
