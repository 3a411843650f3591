"""Best-fit packing of documents into sequences of several permitted lengths.

A document's length is its words plus one separator. Documents longer than the largest sequence are cut into pieces that fill it, and a
rest; every token is packed exactly once. Packing works on lengths alone: a bin is opened for the longest piece left, for every permitted
capacity the best fit of the lengths left is tried (again and again the longest that still fits), and the capacity whose cost for each
packed token is least is opened. In the end each bin is downsized to the least capacity that holds its contents.

At scale rows are dealt by hash into packing groups of about GROUP_ROWS pieces, each packed alone: a group wastes at most its last few
bins. No key of the data decides the group, so that no source or copy is hot, and a group's memory is bounded by design.

Defined cases: null and empty texts have length 1 (the separator); an empty table gives an empty result; repeated rows are packed as
often as they occur; other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, word_count, written

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin besides its length, in tokens.
BIN_COST = 16
GROUP_ROWS = 20_000

SCHEMA = "piece long, start long, n_tokens long, bin_id string, position long, offset long, capacity long"


def fill(counts: dict[int, int], lengths: list[int], first: int, room: int) -> list[tuple[int, int]]:
    """Best fit of one bin: first, then repeatedly the longest that fits; (length, how many). Nothing is taken out."""
    out, used, at = [(first, 1)], {first: 1}, len(lengths)
    while room > 0 and (at := bisect_right(lengths, room, 0, at)) > 0:
        x = lengths[at - 1]
        n = min(counts[x] - used.get(x, 0), room // x)
        if n > 0:
            out.append((x, n))
            used[x] = used.get(x, 0) + n
            room -= n * x
        at -= 1
    return out


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST) -> list[tuple[int, list[int]]]:
    """(capacity, indexes in order) of each bin; every index once. sizes are from 1 to the largest capacity."""
    capacities = sorted(capacities)
    waiting: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        waiting.setdefault(sizes[i], []).append(i)
    counts, lengths = {x: len(v) for x, v in waiting.items()}, sorted(waiting)
    bins = []
    while lengths:
        longest = lengths[-1]
        best = None
        for c in capacities:
            if c >= longest:
                chosen = fill(counts, lengths, longest, c - longest)
                held = sum(x * n for x, n in chosen)
                fitted = next(x for x in capacities if x >= held)  # what the bin is after downsizing
                cost = (fitted + bin_cost) / held
                if best is None or cost < best[0]:
                    best = (cost, fitted, chosen)
        _, capacity, chosen = best
        bins.append((capacity, [waiting[x].pop() for x, n in chosen for _ in range(n)]))
        for x, n in chosen:
            counts[x] -= n
        for x in {x for x, _ in chosen}:
            if not counts[x]:
                del lengths[bisect_right(lengths, x) - 1]
    return bins


def pieces(docs: DataFrame, largest: int, text: str = "text") -> DataFrame:
    """doc_id, piece, start, n_tokens: each document cut at multiples of largest. The last token is the separator."""
    d = docs.select("doc_id", (word_count(F.col(text)) + 1).alias("n"), F.coalesce(F.md5(text), F.lit("")).alias("m"))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest).cast("long"))))
    start = F.col("piece") * largest
    return d.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest)).cast("long").alias("n_tokens"), F.xxhash64("doc_id", "m", "piece").alias("h"))


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST, group_rows: int = GROUP_ROWS, text: str = "text") -> DataFrame:
    """doc_id and SCHEMA: for each piece of each document its bin, its position and offset there, and the bin's capacity."""
    capacities = tuple(sorted(capacities))
    rows = written(pieces(docs, capacities[-1], text), "pack-pieces")
    n = rows.count()
    groups = max(1, -(-n // group_rows))
    # A row's own count within equal hashes spreads repeated rows too.
    spread = F.pmod(F.xxhash64("h", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    dealt = written(rows.withColumn("g", spread), "pack-dealt")
    released(rows)

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        g = table["g"][0].as_py()
        order, bin_id, position, offset, capacity = [], [], [], [], []
        sizes = table["n_tokens"].to_pylist()
        for b, (c, members) in enumerate(pack(sizes, capacities, bin_cost)):
            at = 0
            for k, i in enumerate(members):
                order.append(i)
                bin_id.append(f"{g}-{b}")
                position.append(k)
                offset.append(at)
                capacity.append(c)
                at += sizes[i]
        t = table.take(pa.array(order, pa.int64())).select(["doc_id", "piece", "start", "n_tokens"])
        for name, values, kind in (("bin_id", bin_id, pa.string()), ("position", position, pa.int64()), ("offset", offset, pa.int64()), ("capacity", capacity, pa.int64())):
            t = t.append_column(name, pa.array(values, kind))
        return t

    return dealt.drop("h").groupBy("g").applyInArrow(packed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents packed into sequences of 512, 1,024, 2,048 or 4,096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
