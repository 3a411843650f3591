"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups sorted by size enter the bin with the tightest remaining capacity that still holds them; the bins wait in a balanced tree keyed
by what remains. `best_fit_decreasing` minimises the number of bins of a fixed capacity; for a fixed number of shards the capacity is
searched: the least one, to a relative step, at which the packing opens no more bins than there are shards.

At scale the packing sees few items. A group above 1/GRAIN of all bytes is an item of its own (at most GRAIN of them). All smaller
groups are dealt by hash into GRAIN composite items, which are as indivisible as their groups. So the driver gets at most 2 * GRAIN
numbers however large the table is, and a shard is off its share by about one composite, 1/GRAIN of all bytes, unless one group is
larger than a share.

Defined cases: null texts are one group (size 1 each), empty texts another; an empty table gives an empty result; repeated rows have
slots of their own; all rows of a group share a shard, even if that makes it the largest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import utf8_bytes, written

SHARDS = 16
GRAIN = 8192
SLOT_BUCKETS = 256


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key):
        self.key, self.level, self.left, self.right = key, 1, None, None


class BalancedTree:
    """An AA tree of distinct keys: insert, remove and the least key at or above a bound, each in logarithmic time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            low = t.left
            t.left, low.right = low.right, t
            return low
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.level == t.right.right.level:
            up = t.right
            t.right, up.left = up.left, t
            up.level += 1
            return up
        return t

    def insert(self, key) -> None:
        def put(t):
            if t is None:
                return _Node(key)
            if key < t.key:
                t.left = put(t.left)
            elif key > t.key:
                t.right = put(t.right)
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def cut(t, key):
            if t is None:
                return None
            if key < t.key:
                t.left = cut(t.left, key)
            elif key > t.key:
                t.right = cut(t.right, key)
            elif t.left is None and t.right is None:
                return None
            elif t.left is None:
                n = t.right
                while n.left:
                    n = n.left
                t.key, t.right = n.key, cut(t.right, n.key)
            else:
                n = t.left
                while n.right:
                    n = n.right
                t.key, t.left = n.key, cut(t.left, n.key)
            level = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if level < t.level:
                t.level = level
                if t.right and level < t.right.level:
                    t.right.level = level
            t = self._skew(t)
            t.right = self._skew(t.right)
            if t.right:
                t.right.right = self._skew(t.right.right)
            t = self._split(t)
            t.right = self._split(t.right)
            return t

        self.root = cut(self.root, key)

    def at_least(self, bound):
        t, best = self.root, None
        while t:
            if t.key >= bound:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def best_fit_decreasing(sizes: Sequence[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item; None if more than most bins would open. Equal sizes keep their order, equal room goes to the older bin."""
    if sizes and max(sizes) > capacity:
        return None
    tree, bins, out = BalancedTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.at_least((sizes[i], -1))
        if found is None:
            if most is not None and bins >= most:
                return None
            room, b = capacity, bins
            bins += 1
        else:
            room, b = found
            tree.remove(found)
        out[i] = b
        tree.insert((room - sizes[i], b))
    return out


def pack_shards(sizes: Sequence[int], shards: int) -> list[int]:
    """The bin of each item under the least capacity, to one part in 100,000, at which best-fit-decreasing needs no more than so many bins."""
    if not sizes:
        return []
    low = max(max(sizes), -(-sum(sizes) // shards))
    high = low + max(sizes)  # always enough: no bin stays below the mean when another is above mean + largest
    best = best_fit_decreasing(sizes, low, shards)
    if best is not None:
        return best
    while (best := best_fit_decreasing(sizes, high, shards)) is None:
        high *= 2
    while high - low > max(1, low // 100_000):
        mid = (low + high) // 2
        if (found := best_fit_decreasing(sizes, mid, shards)) is None:
            low = mid
        else:
            high, best = mid, found
    return best


def narrow_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the group's key; written, so that texts are read once."""
    text = F.col("text")
    group = F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text))
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0))
    return written(docs.select("doc_id", (utf8_bytes(text) + 1).alias("size"), crc.cast("long").alias("text_crc32"), group.alias("grp")), "shard-rows")


def assign(rows: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """rows(grp, size, ...) with shard. Groups: partial sums in each task, so a hot group is one row a task in the shuffle."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64("grp"), F.lit(grain))
    groups = written(rows.groupBy("grp").agg(F.sum("size").alias("bytes")).withColumn("bucket", bucket), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * F.lit(grain) > F.lit(total)
    # At most grain groups can each hold more than 1/grain of the total, and there are grain buckets.
    own = groups.filter(large).select("grp", "bytes").orderBy("grp").collect()
    mixed = groups.filter(~large).groupBy("bucket").agg(F.sum("bytes").alias("bytes")).orderBy("bucket").collect()
    bins = pack_shards([r["bytes"] for r in own] + [r["bytes"] for r in mixed], shards)
    by_group = spark.createDataFrame([(r["grp"], b) for r, b in zip(own, bins, strict=False)], "grp string, own_shard int")
    by_bucket = spark.createDataFrame([(r["bucket"], b) for r, b in zip(mixed, bins[len(own) :], strict=True)], "bucket long, mixed_shard int")
    # Both are bounded by grain rows.
    out = rows.withColumn("bucket", bucket).join(F.broadcast(by_group), "grp", "left").join(F.broadcast(by_bucket), "bucket", "left")
    return out.withColumn("shard", F.coalesce("own_shard", "mixed_shard")).drop("bucket", "own_shard", "mixed_shard")


def with_slots(rows: DataFrame, *order: str) -> DataFrame:
    """Adds slot, 0 to n - 1 within each shard. Rows are dealt into SLOT_BUCKETS by hash, counted, and numbered from the sum of the counts before:
    no task sorts a shard."""
    b = F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)).cast("int")
    rows = written(rows.withColumn("__b", b), "shard-assigned")
    counts = rows.groupBy("shard", "__b").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    # shards * SLOT_BUCKETS rows
    starts = counts.select("shard", "__b", F.coalesce(before, F.lit(0)).alias("__from"))
    number = F.row_number().over(Window.partitionBy("shard", "__b").orderBy(*order)) - 1
    return rows.withColumn("__n", number).join(F.broadcast(starts), ["shard", "__b"]).withColumn("slot", F.col("__from") + F.col("__n")).drop("__b", "__n", "__from")


def shard_documents(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """doc_id, size, text_crc32, grp, shard, slot of all documents under the law `bytes`."""
    return with_slots(assign(narrow_rows(docs), shards, grain), "doc_id", "grp")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents in 16 shards of nearly equal bytes; equal texts stay together."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
