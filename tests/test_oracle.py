"""Every engine query against its SQL in DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tickframe.oracle import ORACLE
from tickframe.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("lineitem", "events", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    yield con
    con.close()


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, str(DATA))
    want = sql.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: [str(v) for v in row]
    rows = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=key) == rows
