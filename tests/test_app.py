"""Configuration, watchlists, sinks and the command line; closed bars of a stream."""

import io
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_engine import bars_of, walk

from tickframe.app.cli import main, value_of
from tickframe.app.config import ConfigError, load_config, load_watchlist, secret
from tickframe.app.sinks import cell, whole_states
from tickframe.streaming.closed_bars import stream_bars
from tickframe.timeframe import Timeframe


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert load_config().scan.lookback == 300
    with pytest.raises(FileNotFoundError):
        load_config("none.toml")
    script = tmp_path / "s.pine"
    script.write_text('indicator("Mine")\nplot(ta.sma(close, input.int(3, "N")), "v")')
    at = tmp_path / "tickframe.toml"
    at.write_text(f'[scan]\nlimit = 5\n[engines.momentum]\nmom_len = 7\n[engines.regime]\nrsi_htf = "1h"\n[script."{script}"]\nN = 2\n')
    c = load_config()
    assert (c.scan.limit, c.momentum.mom_len, c.regime.rsi_htf) == (5, 7, Timeframe.H1)
    assert [e.prefix for e in c.engines({str(script): {"N": 4}})] == ["mb", "ggr", "sf", "mine"]
    at.write_text("[scan]\nlimits = 5\n")
    with pytest.raises(ConfigError, match="limits"):
        load_config()
    (tmp_path / ".env").write_text('# A=1\nexport B="two"\n')
    assert secret("B") == "two" and secret("A") == ""


def test_watchlist(tmp_path):
    at = tmp_path / "w.txt"
    at.write_text("aa\n# no\n bb # yes\n\n")
    assert load_watchlist(str(at)) == ["AA", "BB"] == load_watchlist("aa, bb,")
    for bad in ("none.txt", "a/b", " "):
        with pytest.raises(FileNotFoundError):
            load_watchlist(bad)


def test_values_and_cells(spark):
    assert [value_of(x) for x in ("true", "3", "2.5", "x")] == [True, 3, 2.5, "x"]
    assert [cell(*x) for x in (("mb_state", 2), ("day_chg", 1.0), ("x", None), ("x", 1234.5), ("up", True))] == ["+2", "+1.00%", "-", "1,234.50", "yes"]
    df = whole_states(spark.createDataFrame([(1.0, 1.5)], "a_state double, b double"))
    assert df.first() == (1, 1.5) and dict(df.dtypes)["a_state"] == "bigint"


def test_scan_command(spark, tmp_path):
    bars = bars_of(spark, walk(160)).union(bars_of(spark, walk(50), "B"))
    bars.write.parquet(str(tmp_path / "bars"))
    out, base = io.StringIO(), ["--path", str(tmp_path / "bars"), "--timeframe", "1D"]
    code = main(["scan", "a,b,z", *base, "--json", str(tmp_path / "r.json"), "--csv", str(tmp_path / "csv"), "--parquet", str(tmp_path / "pq")], spark, out)
    made = json.loads((tmp_path / "r.json").read_text())
    assert code == 0 and list(made["rows"]) == ["A"] and set(made["errors"]) == {"B", "Z"} and "skipped B" in out.getvalue()
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 1 == spark.read.csv(str(tmp_path / "csv"), header=True).count()
    assert main(["scan", "z", *base], spark, out) == 1
    assert main(["doctor", *base], spark, out) == 0 and "rth: 210 bars" in out.getvalue()
    assert main(["sources"], spark, out) == 0


def test_stream_gives_closed_bars_only(spark, tmp_path):
    """Batches in order of time: the last bucket isn't closed, the others equal the batch plan."""
    schema = "symbol string, ts timestamp, price double, volume double, id long"
    rows = [("A", datetime(2026, 1, 5) + timedelta(minutes=7 * i), float(i % 11), 1.0, i) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream_bars(source, "1 hour", "0 minutes").writeStream.format("memory").queryName("closed").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    got = {tuple(r) for r in spark.table("closed").collect()}
    want = {tuple(r) for r in stream_bars(spark.createDataFrame(rows, schema)).filter(F.col("ts") < "2026-01-05 06:00:00").collect()}
    assert got == want and len(got) == 6
