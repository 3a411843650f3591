"""N-gram Jaccard join by vertical partitioning: which texts share PERCENT of their sets of word shingles, exactly.

Global order: shingles by document frequency (over different sets, in classes of an eighth of a power of two), then by hash. A shingle of one set
only is first; it counts for the set's size and prefix and is never met again. To link, two sets must share one of the first
|x| - ceil(PERCENT * |x|) + 1 shingles of both (the prefix), and a set of which fewer than PERCENT occur in any other set can't link at all.

Vertical partitioning: the order is cut at pivots into FRAGMENTS with about equally many shingles, each set into one segment a fragment. Sets that may
link make families: a prefix shingle's leader is the least set that has it, and a family is what shares a shingle with one leader. A family is a
unit, a large one is cut into blocks that are. In a unit the overlaps of all its pairs are counted fragment by fragment, a fragment's segments in memory at a
time, and the partial counts are summed per pair; a pair links if 100 * overlap >= PERCENT * union. Pairs never leave their task, only a spanning
forest of the links does.

Families are met in two rounds: in blocks by two different deals, which unites what is densely linked, and then block against block, but only where
two components of the first round meet. A family whose members do not link costs counts by the square of its size, spread over its blocks' pairs;
rows grow with its size times its number of blocks.

Document frequencies come from one exchange of all shingles by hash, packed as sorted blocks (about 9 bytes a shingle), in two steps where there
are many buckets. Shingles that alone would overfill a bucket are found while the sets are made, by counts within batches; they are last in the
order, need no count, and stay with their sets.

A shingle is known by its XXH64 (seed 42), a set by the XXH3 of its sorted hashes. Only distinct sets are met, so copies cost nothing.

Defined cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; fewer words than a shingle are one
shingle; repeated rows are rows of one component; null ids are left out of a component's least id (null if it has no other); other columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, give_back, released, scratch, written
from .simhash import _whole_groups, components, shingle_hashes

SHINGLE = 5
#: A link: this share of the union in both sets, in hundredths.
PERCENT = 80
FRAGMENTS = 4
#: Sets of a family that are met at once, about.
BLOCK = 256
#: Shingles of a bucket, about; buckets that one step deals to; shingles that a task holds before it packs them.
BUCKET = 1 << 21
STEP = 256
HELD = 1 << 20
#: A shingle of more sets than this is hot; at most so many are told to all tasks (else the limit is raised).
HOT = 1 << 19
MOST_HOT = 1 << 20
#: Class of hot shingles, after all others.
LAST = 600
#: Bytes of text that are shingled at once; a longer text goes alone.
SLICE = 1 << 20
LONGS = T.ArrayType(T.LongType())


def least_overlap(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The fewest shingles that a set of n shares with one it links to."""
    return np.asarray(-(-percent * n // 100)).astype(np.int64)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - least_overlap(n, percent) + 1


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    part = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)) // SLICE
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for low, high in zip(at, at[1:], strict=False):
        if high > low:
            hashes, made = shingle_hashes(texts.slice(low, high - low), size)
            yield from map(np.unique, np.split(hashes, np.cumsum(made)[:-1]))


def _known(hashes: np.ndarray) -> int:
    """A set's number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def with_sets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = SHINGLE) -> DataFrame:
    """keep, set (null: no shingle), n and, once a batch, often: shingles that a fiftieth of its sets and 16 at least have, with their counts."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("set", "long").add("n", "long").add("often", LONGS).add("times", LONGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch["__text"], size))
            known = [_known(x) if len(x) else None for x in sets]
            own = {k: x for k, x in zip(known, sets, strict=True) if k is not None}
            often, times = np.unique(np.concatenate([*own.values(), np.zeros(0, np.uint64)]), return_counts=True)
            enough = times >= max(16, len(own) / 50)
            said = [[often[enough].view(np.int64), times[enough]], *[[None, None]] * (len(sets) - 1)][: len(sets)]
            lists = [pa.array([s[k] for s in said], pa.list_(pa.int64())) for k in (0, 1)]
            give_back()
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in keep), pa.array(known, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *lists], [*keep, "set", "n", "often", "times"]
            )

    return rows.mapInArrow(run, schema)


def hot_shingles(sets: DataFrame, least: int = HOT, most: int = MOST_HOT) -> np.ndarray:
    """Sorted hashes of the shingles that batches counted at least `least` times in all; the limit is raised until there are at most `most`."""
    sums = sets.filter("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy(F.col("x.often").alias("h")).agg(F.sum("x.times").alias("c"))
    sums = sums.filter(F.col("c") >= least)
    while (n := sums.count()) > most:
        least *= 2
        sums = sums.filter(F.col("c") >= least)
    return np.sort(np.array([r["h"] for r in sums.select("h").collect()] if n else [], np.int64).view(np.uint64))


PACKED = "bucket long, salt int, ids binary, sizes binary, hashes binary, at binary"


def _gaps(h: np.ndarray) -> bytes:
    """Sorted hashes: the first one, then the distances to the next, in six bytes each if all fit."""
    gaps = np.diff(h)
    data = gaps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if not len(gaps) or int(gaps.max()) < 1 << 48 else gaps.tobytes()
    return h[:1].tobytes() + data


def _hashes(data: bytes, n: int) -> np.ndarray:
    """The inverse of _gaps for n hashes."""
    out = np.zeros((n, 8), np.uint8)
    out[0] = np.frombuffer(data[:8], np.uint8)
    if n > 1:
        width = (len(data) - 8) // (n - 1)
        out[1:, :width] = np.frombuffer(data, np.uint8, offset=8).reshape(-1, width)
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def _packed(place: np.ndarray, h: np.ndarray, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """Shingles h of the sets ids[at], a row for each bucket of place."""
    order = np.lexsort((at, h, place))
    h, at, place = h[order], at[order], place[order]
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(h)]
    rows: list[tuple] = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            used, own = np.unique(at[low:high], return_inverse=True)
            own = own.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
            rows.append((int(place[low]), salt, ids[used].tobytes(), sizes[used].astype(np.uint32).tobytes(), _gaps(h[low:high]), own.tobytes()))
        if len(rows) >= 1024 or high == len(h) and rows:
            types = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], PACKED_NAMES)
            rows = []


PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def bucket_of(h: np.ndarray, shift: int, buckets: int) -> np.ndarray:
    """Which of so many even parts of the hashes' range: buckets is a power of two, after the first shift bits."""
    return ((h << np.uint64(shift)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, hashes, at, ids, sizes) of each row."""
    for bucket, ids, sizes, h, at in zip(batch["bucket"].to_pylist(), *(batch[k].to_pylist() for k in ("ids", "sizes", "hashes", "at")), strict=True):
        ids = np.frombuffer(ids, np.int64)
        at = np.frombuffer(at, np.uint16 if len(ids) <= 1 << 16 else np.uint32).astype(np.int64)
        yield bucket, _hashes(h, len(at)), at, ids, np.frombuffer(sizes, np.uint32).astype(np.int64)


class _Pack:
    """Shingles that wait to be packed, a row a bucket: buckets cut the range of the hashes after `shift` bits evenly. Hot shingles go by their set's
    number instead, to buckets from `apart` on."""

    def __init__(self, shift: int, buckets: int, hot: np.ndarray | None = None, apart: int = 0):
        task = TaskContext.get()
        self.shift, self.buckets, self.hot, self.apart, self.salt = shift, buckets, hot, apart, task.partitionId() if task else 0
        self.clear()

    def clear(self) -> None:
        self.n, self.sets, self.parts = 0, 0, []

    def add(self, h: np.ndarray, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, at + self.sets, ids, sizes))
        self.sets += len(ids)
        self.n += len(h)
        if self.n >= HELD:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            h, at, ids, sizes = map(np.concatenate, zip(*self.parts, strict=True))
            hot = np.isin(h, self.hot) if self.hot is not None and len(self.hot) else np.zeros(len(h), bool)
            if hot.any():
                yield from _packed(self.apart + bucket_of(ids[at[hot]].view(np.uint64), 0, self.apart), h[hot], at[hot], ids, sizes, self.salt)
            h, at = h[~hot], at[~hot]
            yield from _packed(bucket_of(h, self.shift, self.buckets), h, at, ids, sizes, self.salt)
        self.clear()


#: A set's shared shingles: rows of a set, a shingle and its class in the order.
SHARED = "set long, n long, h long, kind int"


def shared_shingles(docs: DataFrame, total: int, hot: np.ndarray, text: str = "text", size: int = SHINGLE, bucket: int = BUCKET, step: int = STEP) -> DataFrame:
    """set, n, h, kind of the shingles that two sets or more have: kind orders by document frequency. total: shingles of all texts."""
    spark = docs.sparkSession
    # Not fewer buckets than the session's shuffles have partitions, where there is enough for them.
    wanted = max(-(-total // bucket), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // HELD + 1))
    bits = (wanted - 1).bit_length() if wanted > 1 else 0
    first = min(bits, step.bit_length() - 1)
    apart = 1 << bits
    told = spark.sparkContext.broadcast(hot)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pack(0, 1 << first, told.value, apart)
        for batch in batches:
            own: dict[int, np.ndarray] = {}
            for x in _sets(batch["__text"], size):
                if len(x):
                    own.setdefault(_known(x), x)
            if own:
                sizes = np.array([len(x) for x in own.values()], np.int64)
                h, at = np.concatenate(list(own.values())), np.repeat(np.arange(len(own)), sizes)
                yield from out.add(h, at, np.array(list(own), np.int64), sizes)
            give_back()
        yield from out.rest()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets of the first step dealt to those of the second; rows come by bucket, those of hot shingles are dealt already."""
        number, out = -1, _Pack(first, 1 << (bits - first))
        for batch in batches:
            done = pc.greater_equal(batch["bucket"], apart)
            if batch.filter(done).num_rows:
                yield batch.filter(done)
            for own, *rest in _unpacked(batch.filter(pc.invert(done))):
                if own != number:
                    yield from _numbered(out.rest(), number << (bits - first))
                number = own
                yield from _numbered(out.add(*rest), number << (bits - first))
        yield from _numbered(out.rest(), number << (bits - first))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for number, h, at, ids, sizes in _unpacked(batch):
                if number != last and held:
                    yield from _shared(held, last >= apart)
                    held = []
                last = number
                held.append((h, ids[at], sizes[at]))
        if held:
            yield from _shared(held, last >= apart)
        give_back()

    packed = docs.select(F.col(text).alias("__text")).mapInArrow(pack, PACKED)
    if bits > first:
        salts = 1 << max(0, bits - first - 4)
        packed = packed.repartition("bucket", F.pmod("salt", F.lit(salts))).sortWithinPartitions("bucket").mapInArrow(deal, PACKED)
    return packed.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(count, SHARED)


def _numbered(made: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    """Buckets counted from base."""
    for batch in made:
        yield batch.set_column(0, "bucket", pc.add(batch["bucket"], base))


def _shared(held: list[tuple[np.ndarray, ...]], hot: bool) -> Iterator[pa.RecordBatch]:
    h, ids, sizes = map(np.concatenate, zip(*held, strict=True))
    order = np.lexsort((ids, h))
    h, ids, sizes = h[order], ids[order], sizes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])  # a set that came in several batches
    h, ids, sizes = h[new], ids[new], sizes[new]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    c = np.diff(np.append(start, len(h)))
    kind = np.repeat(np.full(len(c), LAST) if hot else np.floor(8 * np.log2(c)), c).astype(np.int32)
    again = np.repeat(hot | (c > 1), c)
    columns = (ids, sizes, h.view(np.int64), kind)
    for low in range(0, len(h), 1 << 16):
        part = again[low : low + (1 << 16)]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)][part]) for x in columns], ["set", "n", "h", "kind"])


#: A set that may link: its shared shingles in the global order.
ALIVE = "set long, n long, hashes binary, kinds binary"


def alive_sets(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The sets of which enough shingles are shared, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, kinds, h in _whole_groups(batches, ["set", "n", "kind", "h"]):
            start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            end = np.append(start[1:], len(ids))
            ok = np.flatnonzero(end - start >= least_overlap(sizes[start], percent))
            bytes_of = lambda x: pa.array([x[start[k] : end[k]].tobytes() for k in ok], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(ids[start[ok]]), pa.array(sizes[start[ok]]), bytes_of(h), bytes_of(kinds.astype(np.uint16))], ["set", "n", "hashes", "kinds"])

    # h as a signed number: any order will do within a kind, as long as all sets have the same.
    return shared.repartition("set").sortWithinPartitions("set", "kind", "h").mapInArrow(run, ALIVE)


def prefixes(alive: DataFrame, percent: int = PERCENT) -> DataFrame:
    """h, set: the shared shingles of each set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch["n"])
            tokens = [np.frombuffer(x, np.int64) for x in batch["hashes"].to_pylist()]
            shared = np.array([len(x) for x in tokens], np.int64)
            most = np.minimum(np.maximum(prefix_length(n, percent) - (n - shared), 0), shared)
            h = np.concatenate([np.zeros(0, np.int64), *(x[:k] for x, k in zip(tokens, most.tolist(), strict=True))])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(np.asarray(batch["set"]), most))], ["h", "set"])

    return alive.select("set", "n", "hashes").mapInArrow(run, "h long, set long")


def _order_keys(kinds: bytes, hashes: bytes) -> np.ndarray:
    """A place in the global order, in steps: 16 of each kind."""
    h = np.frombuffer(hashes, np.int64)
    return np.frombuffer(kinds, np.uint16).astype(np.int64) * 16 + ((h >> 60) + 8)


def pivots(alive: DataFrame, fragments: int = FRAGMENTS) -> np.ndarray:
    """Places of the global order that cut it into fragments of about equally many shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_order_keys(k, h) for k, h in zip(batch["kinds"].to_pylist(), batch["hashes"].to_pylist(), strict=True)]
            key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    # At most 16 keys for each of some 600 kinds.
    found = sorted((r["key"], r["n"]) for r in alive.select("kinds", "hashes").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect())
    upto = np.cumsum([n for _, n in found])
    cuts = np.searchsorted(upto, [upto[-1] * k / fragments for k in range(1, fragments)]) if len(upto) else []
    return np.unique([found[k][0] for k in cuts]) if len(upto) else np.zeros(0, np.int64)


def families(shared: DataFrame) -> DataFrame:
    """family, set: what shares a prefix shingle with the least set that has it. shared: h, set."""
    by = shared.groupBy("h").agg(F.count("*").alias("c"), F.min("set").alias("leader")).filter("c > 1")
    return shared.join(by.select("h", "leader"), "h").select(F.col("leader").alias("family"), "set").distinct()


def units_of(family: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(unit, set of what is met in the first round; family, set of the families that have several blocks). family: family, set."""
    blocks = family.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = family.join(blocks, "family")
    turns = F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("turn")
    dealt = dealt.select("family", "set", "blocks", turns)
    first = dealt.select(F.xxhash64("family", "turn", F.pmod(F.xxhash64("set", "turn"), "blocks")).alias("unit"), "set")
    return first, family.join(blocks.filter("blocks > 1").select("family"), "family", "left_semi")


def united(family: DataFrame, alive: DataFrame, cuts: np.ndarray, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """node, root of the sets that links connect, within families(family, set), a table; each pair of a family is met. alive: ALIVE."""
    batches = arrow_batches(2048, 16 << 20)
    first, several = units_of(family, block)
    links = written(linked(first.withColumn("root", F.col("set")), alive, cuts, percent), "jaccard-links", batches=batches)
    roots = components(links)
    if several.isEmpty():
        return roots
    roots = written(roots, "jaccard-roots")
    more = written(linked(blocks_that_meet(several, roots, block), alive, cuts, percent), "jaccard-links", batches=batches)
    return components(links.union(more))


def blocks_that_meet(family: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """unit, set, root: pairs of blocks of a family, but for those of one component. family: family, set; roots: node, root.

    A component of more than a block has blocks of its own, the others are dealt together."""
    rows = family.join(roots, F.col("set") == F.col("node"), "left").select("family", "set", F.coalesce("root", "set").alias("root"))
    size = rows.groupBy("family", "root").agg(F.count("*").alias("size"))
    apart = size.filter(F.col("size") > block)
    rest = size.filter(F.col("size") <= block).groupBy("family").agg(F.ceil(F.sum("size") / block).alias("parts"))
    rows = rows.join(apart, ["family", "root"], "left").join(rest, "family", "left")
    own = F.xxhash64("root", F.pmod(F.xxhash64("set"), F.ceil(F.col("size") / block)))
    rows = rows.select("family", "set", "root", F.when(F.col("size").isNotNull(), own).otherwise(F.pmod(F.xxhash64("root"), "parts")).alias("block"))
    rows = written(rows, "jaccard-blocks")
    blocks = rows.groupBy("family", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    mixed = F.expr("not (x.low = x.high and y.low = y.high and x.low = y.low)")
    met = x.join(y, F.expr("x.family = y.family and x.block <= y.block")).filter(mixed)
    both = F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block")
    met = met.select(F.col("x.family").alias("family"), F.xxhash64("x.family", "x.block", "y.block").alias("unit"), both)
    return met.join(rows, ["family", "block"]).select("unit", "set", "root")


def linked(units: DataFrame, alive: DataFrame, cuts: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """a, b: a spanning forest of the links between sets of different roots in each unit. units: unit, set, root."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, own, root, n, hashes, kinds in zip(*(batch[k].to_pylist() for k in ("unit", "set", "root", "n", "hashes", "kinds")), strict=True):
                ends = np.searchsorted(_order_keys(kinds, hashes), cuts).tolist()
                at = [0, *ends, len(hashes) // 8]
                rows += [(unit, f, own, root, n, hashes[8 * low : 8 * high]) for f, (low, high) in enumerate(zip(at, at[1:], strict=False)) if high > low or not f]
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["unit", "fragment", "set", "root", "n", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, out = None, []
        for key, fragment, rows in _segments(batches):
            if unit is None or key != unit.key:
                out += unit.links(percent) if unit else []
                unit = _Unit(key, rows)
            unit.add(rows)
            if sum(len(a) for a, _ in out) >= 1 << 14:
                yield _pairs(out)
                out = []
        out += unit.links(percent) if unit else []
        yield _pairs(out)
        give_back()

    whole = units.join(alive, "set").select("unit", "set", "root", "n", "hashes", "kinds")
    segments = whole.mapInArrow(cut, "unit long, fragment int, set long, root long, n long, hashes binary")
    return segments.repartition("unit").sortWithinPartitions("unit", "fragment", "set").mapInArrow(count, "a long, b long")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(unit, fragment, rows) of sorted batches; a fragment's rows of a unit come whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        unit, fragment = np.asarray(batch["unit"]), np.asarray(batch["fragment"])
        cuts = [0, *(np.flatnonzero((np.diff(unit) != 0) | (np.diff(fragment) != 0)) + 1).tolist(), len(unit)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            key = int(unit[low]), int(fragment[low])
            if held and key != last:
                yield *last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield *last, pa.Table.from_batches(held)


class _Unit:
    """Overlaps of all pairs of some sets, summed over fragments."""

    def __init__(self, key: int, first: pa.Table):
        self.key = key
        self.sets, self.roots, self.n = (first[k].to_numpy() for k in ("set", "root", "n"))
        self.overlap = np.zeros((len(self.sets), len(self.sets)), np.int64)

    def add(self, rows: pa.Table) -> None:
        """A fragment's segments."""
        tokens = [np.frombuffer(x, np.int64) for x in rows["hashes"].to_pylist()]
        if sum(map(len, tokens)) == 0:
            return
        own = np.repeat(np.searchsorted(self.sets, rows["set"].to_numpy()), [len(x) for x in tokens])
        _, place, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        again = times > 1
        column = np.cumsum(again) - 1
        ok = again[place]
        own, place = own[ok], column[place[ok]]
        width = max(64, (1 << 22) // len(self.sets))
        for low in range(0, int(again.sum()), width):
            part = (place >= low) & (place < low + width)
            has = np.zeros((len(self.sets), min(width, int(again.sum()) - low)), np.float32)
            has[own[part], place[part] - low] = 1
            self.overlap += (has @ has.T).astype(np.int64)

    def links(self, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
        union = self.n[:, None] + self.n - self.overlap
        link = (100 * self.overlap >= percent * union) & (self.roots[:, None] != self.roots)
        left, out = link.any(axis=1), []
        for k in np.flatnonzero(left):
            if not left[k]:
                continue
            left[k], frontier = False, [k]
            while frontier:
                a = frontier.pop()
                found = np.flatnonzero(link[a] & left)
                left[found] = False
                if len(found):
                    out.append((np.full(len(found), self.sets[a]), self.sets[found]))
                    frontier.extend(found)
        return out


def _pairs(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)])) for k in (0, 1)], ["a", "b"])


def set_components(docs: DataFrame, sets: DataFrame, text: str = "text", size: int = SHINGLE, percent: int = PERCENT, *, block: int = BLOCK,
                   bucket: int = BUCKET, step: int = STEP, hot: int = HOT, fragments: int = FRAGMENTS) -> DataFrame:
    """node, root: the sets that are linked with another and the least set of their component, as a table. sets: what with_sets gave for docs."""
    with scratch(docs.sparkSession):
        total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
        shared = written(shared_shingles(docs, total, hot_shingles(sets, hot), text, size, bucket, step), "jaccard-shared")
        alive = written(alive_sets(shared, percent), "jaccard-alive")
        released(shared)
        family = written(families(written(prefixes(alive, percent), "jaccard-prefixes")), "jaccard-families")
        return written(united(family, alive, pivots(alive, fragments), percent, block), "jaccard-components", result=True)


def join_documents(docs: DataFrame, text: str = "text", size: int = SHINGLE, percent: int = PERCENT, **bounds) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the least doc_id that links reach, the document itself included."""
    with scratch(docs.sparkSession):
        sets = written(with_sets(docs, ("doc_id",), text, size), "jaccard-sets")
        roots = set_components(docs, sets, text, size, percent, **bounds)
        per = sets.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
        per = written(per.join(roots, F.col("set") == F.col("node"), "left").select("set", "least", F.coalesce("root", "set").alias("root")), "jaccard-per-set")
        best = per.groupBy("root").agg(F.min("least").alias("component_id"))
        found = per.join(best, "root").select("set", "component_id")
        out = sets.select("doc_id", "set", F.col("n").alias("n_shingles")).join(found, "set", "left")
        return written(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "jaccard-documents", result=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: components of all documents whose sets of five-word shingles share 80 % of their union."""
    return join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
o AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT k, k FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM d LEFT JOIN n USING (k) JOIN r ON r.x = d.k JOIN d t ON t.k = r.y GROUP BY d.k, d.doc_id, n.n
"""
