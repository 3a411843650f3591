"""SimHash near-duplicates through deletion-variant signatures.

Fingerprint: 64 bits over the XXH64 hashes (seed 42) of a text's word shingles; a bit is 1 if it is set in over half of them.

Candidates: the 64 bits are cut into three segments (22, 21, 21 bits). If two fingerprints differ in at most 4 bits, some segment of theirs
differs in at most one. Each fingerprint is indexed under the 64 variants of its segments with one bit deleted (a wildcard); segments that
differ in at most one bit share a variant. Equal variants meet by a hash exchange and a sort, and every candidate is verified on all 64 bits.
Only distinct fingerprints are indexed, so exact copies cost nothing.

Links: in a small group of equal variants all pairs are verified, and a pair is reported only under its first common variant. In a large one a
search takes each fingerprint out when it is first reached, so that the group gives a spanning forest, at most one link for each member, and
a dense cluster is not compared pair by pair. No link between fingerprints is lost as far as connection goes.

Deduplication: fingerprints are those of the set of shingles, which similarity is about too, and a node is a distinct set, known by its hash.

Wider fingerprints: `words` hash words of 64 bits each, cut alike, so that some segment differs in at most one bit if 6 * words - 1 bits or fewer
differ in all. Deduplication takes NEAR_WORDS words over five-word shingles, meets what shares a variant, one word after the other, keeps pairs
within NEAR_BITS of the 128 bits of that word and the next, and then holds the texts of each pair against each other: a link needs a Jaccard
similarity of 0.8 or more over their sets of shingles. Bits don't decide there, so in a large family nearly all would be held against all. What is in a
large group or has more than CROWD candidates is the crowd, and makes no pairs with its like: the exact join of sets (see jaccard) connects all of the
crowd that are alike, bits or no bits. Pairs with one outside of the crowd go by candidates, at most CROWD for each such one.

Components: alternating large-star and small-star steps over the links, written to the shared folder after each round.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other; texts of fewer words than a
shingle are one shingle; repeated rows are rows of the same component; null ids are left out of a component's least id (null if it has no
other); an empty table gives an empty result; other columns stay where documents are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, as_struct, give_back, released, scratch, written

SHINGLE = 4
MOST_BITS = 4
SEGMENTS = ((0, 22), (22, 43), (43, 64))
#: Deduplication: words of a shingle, hash words of a fingerprint, its candidates' most differing bits, least similarity of a link.
NEAR_SHINGLE = 5
NEAR_WORDS = 6
NEAR_BITS = 40
SIMILARITY = 0.8
#: Groups of equal variants up to this size are compared pair by pair.
SMALL = 32
#: Deduplication: a distinct set with more candidates than this is of the crowd.
CROWD = 16
#: Bytes of text that are shingled at once; longer texts go alone.
SLICE = 1 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, lower-cased A-Z, in order; the number of words of each text). Null: none."""
    split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    flat, ends = split.flatten(), np.asarray(split.offsets)
    full = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    upto = before[ends - ends[0]]
    return (flat if full.all() else flat.filter(pa.array(full))), np.diff(upto)


#: Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_U = np.uint64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the slices of data, all slices of one length at a time. Lengths that few slices have go through the library."""
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    room = data + bytes(8)
    eight = np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", room, strides=(1,))
    one = np.frombuffer(room, np.uint8)
    with np.errstate(over="ignore"):
        for own in np.split(order, cuts):
            if not len(own):
                continue
            n, at = int(lengths[own[0]]), starts[own]
            if len(own) < 16:
                out[own] = [xxhash.xxh64_intdigest(data[i : i + n], seed) for i in at.tolist()]
                continue
            done = 0
            if n >= 32:
                acc = [np.full(len(own), _U(seed) + x, np.uint64) for x in (_P1 + _P2, _P2, _U(0), _U(0) - _P1)]
                while n - done >= 32:
                    acc = [_round(a, eight[at + (done + 8 * k)]) for k, a in enumerate(acc)]
                    done += 32
                h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
                for a in acc:
                    h = (h ^ _round(_U(0), a)) * _P1 + _P4
            else:
                h = np.full(len(own), _U(seed) + _P5, np.uint64)
            h = h + _U(n)
            while n - done >= 8:
                h = _turn(h ^ _round(_U(0), eight[at + done]), 27) * _P1 + _P4
                done += 8
            if n - done >= 4:
                h = _turn(h ^ (four[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while n > done:
                h = _turn(h ^ (one[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h = (h ^ (h >> _U(33))) * _P2
            h = (h ^ (h >> _U(29))) * _P3
            out[own] = h ^ (h >> _U(32))
    return out


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle of every text in order, number of shingles of each text)."""
    words, n = words_of(texts)
    made = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    if not len(words):
        return np.zeros(0, np.uint64), made
    # Words in a row with one space between them: a shingle is a slice of it.
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer().to_pybytes()
    ends = np.cumsum(np.asarray(pc.binary_length(words)).astype(np.int64) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    first = np.repeat(np.cumsum(n) - n, made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    last = np.minimum(first + size, np.repeat(np.cumsum(n), made)) - 1
    return xxh64(data, begins[first], ends[last] - begins[first]), made


def _hash_word(hashes: np.ndarray, word: int) -> np.ndarray:
    """The word-th 64 bits of each shingle's hash: the XXH64 itself, then its mixes."""
    if not word:
        return hashes
    with np.errstate(over="ignore"):
        h = hashes + _U(word) * _P1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        return h ^ (h >> _U(32))


def _slice_fingerprints(texts: pa.Array, size: int, words: int) -> np.ndarray:
    return _majorities(*shingle_hashes(texts, size), words)


def _majorities(hashes: np.ndarray, made: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros((len(made), words, 64), np.uint8)
    for w in range(words):
        bits = np.unpackbits(_hash_word(hashes, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = 0
        for i, m in enumerate(made.tolist()):
            if m:
                out[i, w] = 2 * bits[at : at + m].sum(axis=0, dtype=np.int32) > m
                at += m
    return np.packbits(out, axis=2, bitorder="little").view(np.uint64).reshape(-1, words)


def fingerprints(texts: pa.Array, size: int = SHINGLE, words: int = 1) -> np.ndarray:
    """uint64 for each text; with more words than one, so many for each text."""
    length = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    part = np.cumsum(length) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
    out = np.concatenate([np.zeros((0, words), np.uint64), *(_slice_fingerprints(texts.slice(a, b - a), size, words) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)])
    return out.ravel() if words == 1 else out


def set_fingerprints(texts: pa.Array, size: int, words: int) -> tuple[np.ndarray, list[bytes]]:
    """(`words` uint64 for each text over its set of shingles, 128-bit hashes of the sets)."""
    length = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    part = np.cumsum(length) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
    out, digests = [np.zeros((0, words), np.uint64)], []
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            hashes, made = shingle_hashes(texts.slice(low, high - low), size)
            sets = [np.unique(x) for x in np.split(hashes, np.cumsum(made)[:-1])]
            digests += [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            out.append(_majorities(np.concatenate(sets), np.array([len(x) for x in sets]), words))
    return np.concatenate(out), digests


def _column(fp: np.ndarray, words: int) -> pa.Array:
    """Fingerprints as a column: a signed long, or the bytes of all words."""
    if words == 1:
        return pa.array(fp.ravel().view(np.int64))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), len(fp), [None, pa.py_buffer(np.ascontiguousarray(fp))]).cast(pa.binary())


def _values(column: pa.Array, words: int) -> np.ndarray:
    """The inverse of _column, always in two dimensions."""
    if words == 1:
        return np.asarray(column).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _bits(diff: np.ndarray) -> np.ndarray:
    """Bits set in each row."""
    n = np.bitwise_count(diff)
    return n if n.ndim == 1 else n.sum(axis=1)


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = SHINGLE, words: int = 1) -> DataFrame:
    """keep and fp, the fingerprint as a signed long (more words than one: as bytes)."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("fp", "long" if words == 1 else "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _column(fingerprints(batch["__text"], size, words), words)
            give_back()
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), fp], [*keep, "fp"])

    return rows.mapInArrow(run, schema)


def with_sets(docs: DataFrame, keep: tuple[str, ...], text: str, size: int, words: int) -> DataFrame:
    """keep, fp (the fingerprint of the set of shingles) and set (the set's hash)."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("fp", "long" if words == 1 else "binary").add("set", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, digests = set_fingerprints(batch["__text"], size, words)
            give_back()
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), _column(fp, words), pa.array(digests, pa.binary())], [*keep, "fp", "set"])

    return rows.mapInArrow(run, schema)


def variants(fp: np.ndarray) -> np.ndarray:
    """(len(fp), bits): for each bit its number and the bits of its segment without it."""
    each = fp if fp.ndim == 2 else fp[:, None]
    out = np.empty((len(fp), 64 * each.shape[1]), np.int64)
    for w in range(each.shape[1]):
        for low, high in SEGMENTS:
            mask = (1 << (high - low)) - 1
            segment = (each[:, w] >> _U(low)) & _U(mask)
            for p in range(low, high):
                out[:, 64 * w + p] = ((segment & _U(mask ^ (1 << (p - low)))) | _U((64 * w + p) << 22)).astype(np.int64)
    return out


def _first_variant(diff: np.ndarray) -> np.ndarray:
    """For XORs of fingerprints: the number of the first bit whose variant both share (-1: none)."""
    each = diff if diff.ndim == 2 else diff[:, None]
    out = np.full(len(diff), -1)
    for w in reversed(range(each.shape[1])):
        for low, high in reversed(SEGMENTS):
            d = (each[:, w] >> _U(low)) & _U((1 << (high - low)) - 1)
            n = np.bitwise_count(d)
            bit = 64 * w + low + np.bitwise_count(d - _U(1) & ~d).astype(int)
            out = np.where(n == 0, 64 * w + low, np.where(n == 1, bit, out))
    return out


def spanning_links(fp: np.ndarray, most: int = MOST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, those first reached from a): a spanning forest of the links among fp."""
    left = fp
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            a = frontier.pop()
            near = _bits(left ^ a) <= most
            if near.any():
                found, left = left[near], left[~near]
                yield a, found
                frontier.extend(found)


def _group_links(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups of equal, sorted keys."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    small = np.repeat(size <= SMALL, size)
    a, b = [], []
    for step in range(1, min(SMALL, int(size.max(initial=1)))):
        near = (key[step:] == key[:-step]) & small[step:]
        i = np.flatnonzero(near)
        if not len(i):
            break
        diff = fp[i] ^ fp[i + step]
        ok = _bits(diff) <= most
        i, diff = i[ok], diff[ok]
        ok = _first_variant(diff) == key[i] >> 22
        a.append(fp[i[ok]])
        b.append(fp[i[ok] + step])
    for k in np.flatnonzero(size > SMALL):
        for x, found in spanning_links(fp[start[k] : start[k] + size[k]], most):
            a.append(np.repeat(x[None], len(found), axis=0))
            b.append(found)
    none = np.zeros((0, *fp.shape[1:]), np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, most: int = MOST_BITS, words: int = 1) -> DataFrame:
    """a, b: pairs of different fingerprints that connect all that differ in at most most bits and share a variant. distinct: fp, no value twice."""
    names = [f"fp{w}" for w in range(words)]
    node = "long" if words == 1 else "binary"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _values(batch["fp"], words)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(variants(part).ravel()), *(pa.array(np.repeat(part[:, w].view(np.int64), 64 * words)) for w in range(words))], ["key", *names])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(key, fp):
            a, b = _group_links(key, fp, most)
            return pa.RecordBatch.from_arrays([_column(a, words), _column(b, words)], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last group so far, which may go on
        for batch in batches:
            key, fp = np.asarray(batch["key"]), np.stack([np.asarray(batch[x]).view(np.uint64) for x in names], axis=1)
            if not len(key):
                continue
            if held and held[0][0][0] == key[-1]:
                held.append((key, fp))
                continue
            last = int(np.searchsorted(key, key[-1]))
            parts = [*held, (key[:last], fp[:last])]
            yield linked(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            held = [(key[last:], fp[last:])]
        if held:
            yield linked(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held]))

    indexed = distinct.mapInArrow(index, "key long, " + ", ".join(f"{x} long" for x in names))
    return indexed.repartition("key").sortWithinPartitions("key", *names).mapInArrow(join, f"a {node}, b {node}")


def jaccard(left: pa.Array, right: pa.Array, size: int = NEAR_SHINGLE) -> np.ndarray:
    """Similarity of the sets of shingles of each pair of texts, 0 where both have none. A text that many pairs name is shingled once."""
    n = len(left)
    coded = pa.concat_arrays([left, right]).dictionary_encode(null_encoding="encode")
    at, texts = np.asarray(coded.indices), coded.dictionary
    length = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    part = np.cumsum(length) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
    sets: list[np.ndarray] = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            hashes, made = shingle_hashes(texts.slice(low, high - low), size)
            sets += map(np.unique, np.split(hashes, np.cumsum(made)[:-1]))
    out = np.zeros(n)
    for i, (a, b) in enumerate(zip(at[:n].tolist(), at[n:].tolist(), strict=True)):
        few, many = sorted((sets[a], sets[b]), key=len)
        if len(few):
            both = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few)
            out[i] = both / (len(few) + len(many) - both)
    return out


def similar(found: DataFrame, texts: DataFrame, least: float = SIMILARITY, size: int = NEAR_SHINGLE) -> DataFrame:
    """Those links of found(a, b) whose texts(fp, t), one for each fingerprint, are as similar as least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = jaccard(batch["ta"], batch["tb"], size) >= least
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    left = texts.select(F.col("fp").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("fp").alias("b"), F.col("t").alias("tb"))
    return found.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, found.select("a", "b").schema)


#: Edges that one task of a round of components takes, about.
EDGES_A_TASK = 1 << 18


def components(edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """node, root for every node of edges(a, b): root is the least node of its component.

    Each round: large-star joins a node's greater neighbours to its least one, small-star joins its lesser ones. Rounds end when the
    edges stay as they are; the number of rounds grows with the logarithm of a component's size. A round has as many tasks as its edges need: those
    of one task are met without an exchange.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = written(e, "star-0"), None
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    for turn in range(1, 200):
        state = e.agg(F.count("*").alias("n"), mark.alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (state["n"], state["h"])
        tasks = -(-state["n"] // edges_a_task)
        near = e.coalesce(tasks)
        ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = near.select(ways.alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.coalesce(tasks), f"star-{turn}a")
        near, before = large.coalesce(tasks), e
        lower = near.groupBy("u").agg(F.min("v").alias("m"))
        joined = near.join(lower.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(joined.union(lower.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks), f"star-{turn}b")
        released(large, before)
    raise RuntimeError("components did not settle")


def grouped(rows: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """fp, component_id for each distinct fingerprint of rows(doc_id, fp): component_id is the least doc_id of all documents connected to it."""
    with scratch(rows.sparkSession):
        per = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
        found = written(links(per.select("fp"), most), "simhash-links")
        per = written(_with_roots(per, found), "simhash-roots")
        least = per.groupBy("root").agg(F.min("least_id").alias("component_id"))
        return written(per.join(least, "root").select("fp", "component_id"), "simhash-components", result=True)


def _with_roots(per: DataFrame, found: DataFrame) -> DataFrame:
    """per(fp, ...) and root, the least fingerprint of the component that the links found(a, b) make."""
    return per.join(components(found), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def components_of_documents(docs: DataFrame, most: int = MOST_BITS, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    with scratch(docs.sparkSession):
        rows = written(with_fingerprints(docs, size=size), "simhash-rows")
        return written(rows.join(grouped(rows, most), "fp", "left").select("doc_id", "fp", "component_id"), "simhash-documents", result=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: fingerprints of all documents and their components at 4 bits."""
    out = components_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut so that no group of equal values of the first one is split."""
    held: list[list[np.ndarray]] = []  # the last group so far, which may go on
    for batch in batches:
        columns = [np.asarray(batch[x]) for x in names]
        if not len(columns[0]):
            continue
        if held and held[0][0][0] == columns[0][-1]:
            held.append(columns)
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        parts = [*held, [c[:last] for c in columns]]
        if sum(len(p[0]) for p in parts):
            yield [np.concatenate(c) for c in zip(*parts, strict=True)]
        held = [[c[last:] for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _put_together(made: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns as batches of some 32,768 rows."""
    held, n = [], 0
    for columns in made:
        held.append(columns)
        n += len(columns[0])
        if n >= 1 << 15 or len(held) >= 1 << 15:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(np.concatenate, zip(*held, strict=True))], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(np.concatenate, zip(*held, strict=True))], names)


def _two_words(fp: np.ndarray, word: int) -> np.ndarray:
    """A word of fingerprints and the next one (none if there is but one)."""
    own = fp[:, word]
    return np.stack([own, fp[:, (word + 1) % fp.shape[1]] if fp.shape[1] > 1 else np.zeros_like(own)], axis=1)


def _few(a: np.ndarray, b: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs a, b, sorted. Of an a in `many` or with more than CROWD of them only a pair with -1 is left."""
    pairs = np.unique(np.stack([np.append(a, many), np.append(b, np.full(len(many), -1))], axis=1), axis=0)
    a, b = pairs.T
    start = np.flatnonzero(np.diff(a, prepend=-1))
    n = np.diff(np.append(start, len(a)))
    crowd = (n > CROWD) | (b[start] < 0)
    few = ~np.repeat(crowd, n)
    return np.append(a[few], a[start[crowd]]), np.append(b[few], np.full(crowd.sum(), -1))


def met(nodes: DataFrame, word: int, words: int, most: int) -> DataFrame:
    """node, other: each candidate pair that shares a variant of a word of nodes(node, fp, crowd), both ways round. other -1: the node is in a large
    group or has more than CROWD others, and not all of them are named. Of those known to be of the crowd nothing is said but as others."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = _two_words(_values(batch["fp"], words), word), np.asarray(batch["node"])
            for at in range(0, len(fp), 2048):
                part = fp[at : at + 2048]
                columns = (variants(part[:, 0]).ravel(), *(np.repeat(c, 64) for c in (node[at : at + 2048], *part.view(np.int64).T)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "own", "next"])

    def pairs(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, places, members of large groups)."""
        size = np.diff(np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)))
        small, known = np.repeat(size <= SMALL, size), node < 0
        node, none = np.where(known, ~node, node), np.zeros(0, np.int64)
        yield none, none, np.unique(node[~small & ~known])
        for step in range(1, min(SMALL, int(size.max()))):
            i = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
            if not len(i):
                break
            diff = fp[i] ^ fp[i + step]
            ok = _bits(diff) <= most
            i, diff = i[ok], diff[ok]
            i = i[_first_variant(diff[:, 0]) == key[i] >> 22]
            x, y = i[~known[i]], i[~known[i + step]]
            yield np.append(node[x], node[y + step]), np.append(node[x + step], node[y]), none

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held, n = [], 0
        for key, node, *both in _whole_groups(batches, ["key", "node", "own", "next"]):
            for a, b, many in pairs(key, node, np.stack(both, axis=1).view(np.uint64)):
                held.append((a, b, many))
                n += len(a) + len(many)
            if n >= 1 << 19:
                yield _few(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield _few(*map(np.concatenate, zip(*held, strict=True)))

    # Numbers of the crowd go as negative ones, so that they need no column of their own.
    marked = nodes.select(F.when(F.col("crowd"), F.bitwise_not("node")).otherwise(F.col("node")).alias("node"), "fp")
    rows = marked.mapInArrow(index, "key long, node long, own long, next long").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(lambda x: _put_together(found(x), ["node", "other"]), "node long, other long")


def crowd_and_pairs(every: DataFrame) -> DataFrame:
    """a, b: for every(node, other) of all words a row with -1 for each node of the crowd, which has more than CROWD others, and the pairs of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for node, other in _whole_groups(batches, ["node", "other"]):
            a, b = _few(node, other, node[other < 0])
            yield np.where(b < 0, a, np.maximum(a, b)), np.minimum(a, b)

    return every.repartition("node").sortWithinPartitions("node").mapInArrow(lambda x: _put_together(run(x), ["a", "b"]), "a long, b long")


def _links_of_sets(texts: DataFrame, least: float, size: int) -> DataFrame:
    """a, b: links that connect all texts(node, t) that are as similar as least, by the exact join of their sets."""
    from . import jaccard  # which takes its shingles and components from here

    sets = written(jaccard.with_sets(texts, ("node",), "t", size), "dedup-sets", batches=arrow_batches(4096, 16 << 20))
    roots = jaccard.set_components(texts, sets, "t", size, round(100 * least, 9))
    own = sets.filter("set IS NOT NULL").select("set", F.col("node").alias("a"))
    first = own.groupBy("set").agg(F.min("a").alias("b"))
    return written(own.join(roots, F.col("set") == F.col("node")).select("a", "root").join(first, F.col("root") == F.col("set")).select("a", "b"), "dedup-links")


def rooted_nodes(nodes: DataFrame, keyed: DataFrame, most: int, words: int, least: float, size: int) -> DataFrame:
    """nodes(node, fp, one) and root, the least node of the component that links of texts as similar as least make. keyed: k, t; one: the k of a node's text."""

    def texts_of(some: DataFrame) -> DataFrame:
        named = nodes.join(some, "node", "left_semi")
        return written(keyed.select("k", "t").join(named, F.col("k") == F.col("one")).groupBy("node").agg(F.first("t").alias("t")), "dedup-texts")

    marked, parts = nodes.withColumn("crowd", F.lit(False)), []
    for word in range(words):
        parts.append(written(met(marked, word, words, most), "dedup-met"))
        rows = written(crowd_and_pairs(reduce(DataFrame.union, parts)), "dedup-few")
        known = rows.filter("b < 0").select(F.col("a").alias("node"), F.lit(True).alias("crowd"))
        marked = nodes.join(known, "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    found = written(rows.filter("b >= 0").distinct(), "dedup-candidates")
    crowd = rows.filter("b < 0").select(F.col("a").alias("node"))
    texts = texts_of(found.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = written(similar(found, texts.withColumnRenamed("node", "fp"), least, size), "dedup-links", batches=arrow_batches(4096, 16 << 20))
    released(texts, found)
    if not crowd.isEmpty():
        texts = texts_of(crowd)
        links = links.union(_links_of_sets(texts, least, size))
        released(texts)
    roots = components(links).withColumnRenamed("node", "n")
    return written(nodes.join(roots, F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("root", "node")).drop("n"), "dedup-roots")


def deduplicate(docs: DataFrame, most: int = NEAR_BITS, size: int = NEAR_SHINGLE, words: int = NEAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """One document of each component, the one with the least id (null last, then the least hash of its text), with the columns it came with.

    Fingerprints of `words` hash words give the candidates; a link needs texts as similar as `least` over shingles of `size` words. Texts of equal
    sets of shingles are one component, texts of equal fingerprints are not unless they are alike. Of rows that repeat an id and text one stays. Whole texts cross an exchange twice, by a key of their own
    that no hot group shares: once to those that candidate links name, once at the end.
    """
    null = F.lit("\x01")
    key = F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), null), F.coalesce(F.md5(F.col("text")), null)))
    keyed = docs.select(as_struct(docs), key.alias("k"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    with scratch(docs.sparkSession):
        rows = written(with_sets(keyed, ("k", "id"), "t", size, words), "dedup-rows")
        nodes = written(rows.groupBy("set").agg(F.min("k").alias("one"), F.first("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()), "dedup-nodes")
        roots = rooted_nodes(nodes, keyed, most, words, least, size)
        joined = rows.join(roots.select("set", "root"), "set")
        best = joined.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("best"))
        kept = written(best.select(F.col("best.k").alias("k")), "dedup-kept", result=True)
    return keyed.select("__row", "k").join(kept, "k", "left_semi").groupBy("k").agg(F.first("__row").alias("__row")).select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
