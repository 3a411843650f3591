"""The REST source against a local server with canned pages."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tickframe.sources.rest import NotConfigured, Reader, TokenBucket, bars_of, errors_of, register
from tickframe.timeframe import Timeframe


def bar(t, c):
    return {"t": t, "o": c, "h": c + 1, "l": c - 1, "c": c, "v": 10}


class Canned(BaseHTTPRequestHandler):
    def do_GET(self):
        at = urlparse(self.path)
        q, code, body = parse_qs(at.query), 200, {}
        if at.path == "/v2/stocks/bars" and "AA" in q["symbols"][0]:
            if "page_token" in q:
                body = {"bars": {"AA": [bar("2026-01-06T05:00:00Z", 9.0), bar("2026-01-07T05:00:00Z", 3.0)]}}
            else:
                body = {"bars": {"AA": [bar("2026-01-05T05:00:00Z", 1.0), bar("2026-01-06T05:00:00Z", 2.0)]}, "next_page_token": "x"}
        elif "/ticker/AA/" in at.path:
            body = {"results": [bar(1767625200000, 1.0)], "next_url": f"http://{self.headers['Host']}/more"}
        elif at.path == "/more":
            body = {"results": [bar(1767628800000, 2.0)]}
        elif "/ticker/BB/" in at.path:
            code = 429
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = HTTPServer(("127.0.0.1", 0), Canned)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


@pytest.fixture
def keys(tmp_path):
    at = tmp_path / "keys"
    at.write_text("ALPACA_KEY_ID=k\nALPACA_SECRET=s\nPOLYGON_API_KEY=p\n")
    return str(at)


def test_alpaca(spark, base, keys):
    register(spark)
    raw = spark.read.format("market_bars").options(vendor="alpaca", symbols="aa,zz", timeframe="1D", base=base, group="1", end="2026-01-08", env_file=keys).load()
    assert [tuple(r) for r in errors_of(raw).collect()] == [("ZZ", "no data returned")]
    bars = bars_of(raw, Timeframe.D1, datetime(2026, 1, 7, 12))
    assert [(r.ts.day, r.close, r.session) for r in bars.orderBy("ts").collect()] == [(5, 1.0, "rth"), (6, 9.0, "rth")]


def test_polygon(spark, base, keys):
    register(spark)
    raw = spark.read.format("market_bars").options(vendor="polygon", symbols="AA,BB,CC", timeframe="1h", base=base, end="2026-01-08", env_file=keys).load()
    assert {r.symbol: r.error for r in errors_of(raw).collect()} == {"BB": "polygon: status 429", "CC": "no data returned"}
    bars = bars_of(raw, Timeframe.H1, datetime(2026, 1, 5, 17, 10), delay_seconds=900)
    assert [(r.ts.hour, r.close) for r in bars.collect()] == [(15, 1.0)]


def test_settings(tmp_path, monkeypatch, keys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("POLYGON_API_KEY", raising=False)
    for options in ({}, {"vendor": "polygon"}, {"vendor": "alpaca", "feed": "x", "env_file": keys}):
        with pytest.raises(NotConfigured):
            Reader(options)
    r = Reader({"vendor": "alpaca", "symbols": "a,b,c", "group": "2", "env_file": keys})
    assert [p.symbols for p in r.partitions()] == [["A", "B"], ["C"]]


def test_token_bucket():
    clock = [0.0]
    b = TokenBucket(5, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    for _ in range(7):
        b.wait()
    assert clock[0] == pytest.approx(24)
