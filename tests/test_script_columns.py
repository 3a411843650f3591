"""What a bar-by-bar script reads of its bars."""

from datetime import datetime, timedelta

import pyarrow as pa

from tickframe.script.engine import Columns, in_order
from tickframe.script.program import Run, analyse

SOURCE = """
var seen = array.new<float>()
array.push(seen, hl2)
plot(array.avg(seen), "mean")
plot(close[1], "before")
plotshape(barstate.islast, "last")
"""


def table():
    start = datetime(2024, 1, 1)
    return pa.table({
        "ts": pa.array([start + timedelta(days=i) for i in range(4)], pa.timestamp("us")), "open": [1.0] * 4, "high": [3.0, 5.0, 7.0, 9.0], "low": [1.0, 1.0, 1.0, 1.0],
        "close": [2.0, None, 4.0, 5.0], "volume": [1.0] * 4, "session": ["rth"] * 4,
    })


def test_only_what_is_read_is_made():
    columns = Columns(table(), {})
    made = Run(analyse(SOURCE), columns, n=4).go().columns
    assert made == [[2.0, 2.5, 3.0, 3.5], [None, 2.0, None, 4.0], [False, False, False, True]]
    assert set(columns) == {"high", "low", "close"}


def test_order_of_times():
    t = table()
    assert in_order(t["ts"]) and in_order(t.slice(0, 0)["ts"]) and not in_order(t.take([1, 0, 2])["ts"])
    assert not in_order(pa.chunked_array([t["ts"].combine_chunks(), pa.array([None], pa.timestamp("us"))]))
