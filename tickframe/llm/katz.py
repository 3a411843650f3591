"""Katz back-off language model over words, of any order from 2, and the scores of texts under it.

P(w | h) = d_r c(h, w) / c(h) if the n-gram was seen (r = c(h, w)), else alpha(h) P(w | h without its first word); below pairs,
P(w) = d_r c(w) / N if the word was seen, else what Good-Turing leaves for all unseen words together. d_r are Good-Turing discounts of each
order for r up to K, 1 above; alpha(h) is what the seen n-grams leave, over 1 minus the sum of the lower order's P over the seen w, so that
every context's probabilities sum to 1 exactly; an unseen context passes everything on. A context whose n-grams are all above K would leave
nothing; its counts are divided by c(h) + 1 instead. A discount that the counts of counts put outside (0, 1) is replaced by (r - 1/2) / r.

Evaluation recurses token by token: n-gram, else context weight and the next lower order, at last the word or the unseen class.

How it runs. Each order has a table of its own, partitioned by kind (types, docs, open, hot, blocks) and made by buckets of contexts. Texts are
tokenised in blocks; a block sends to each bucket its distinct n-grams, for the highest order with the documents that have them, packed into one
binary value (sorted 8-byte hashes as byte planes, zstd). A bucket sums the counts of all blocks: c(h, w), and c(h), which for pairs is also the
word's count. It knows everything about seen n-grams, so it returns per block one packed row of sums for each document. N-grams that training
never saw (only held-out documents have them) go on as `open` rows through the lower orders: joins on hashes, hot words split by Spark's skew
handling. Pairs always carry the sums of the base score.

Hot contexts: a sample of texts (one in HOT_SAMPLE by hash) shows which contexts take more than half a bucket's share; these are dealt over several
buckets by their next word. What needs such a context's totals is returned as `hot` rows for each document and added once the totals are known.
The sample decides where n-grams go, never what is counted. At most two hot contexts a bucket can exist, so their list is bounded.

Memory: a task holds one block (BLOCK_BYTES of text; longer texts are cut and go on in the next block) or one bucket; buckets follow the input's size.

Hashes of words and contexts are 64 bits: two of a billion words share one with probability 0.03. A block's number is its partition and place, so
the input must give the same rows in the same partitions when a task runs again, as a table that was read does.

Defined cases: null text is empty (one token, the end); an empty training set gives every token the unseen class, probability 1; repeated
rows count as often as they occur, in whatever partitions; null ids are trained on like any other; ids have any type; other columns of the
input are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, give_back, scratch, written
from .simhash import words_of, xxh64

K = 5
ORDER = 2
#: Buckets: at least so many, and one for each so many bytes of input as Spark estimates them.
LEAST_BUCKETS, BUCKET_BYTES = 96, 8 << 20
#: Spark's estimate for what it can't estimate is above this.
UNKNOWN = 1 << 60
#: Bytes of text in a block at most: bounds what a task holds.
BLOCK_BYTES = 8 << 20
#: Texts, and about how many bytes of them, that Spark hands over at a time.
BATCHES = arrow_batches(1000, 8 << 20)
HOT_SAMPLE = 32
START, END = 1, 2  # in place of hashes
_U = np.uint64
_SPACE = re.compile(rb"[\x09-\x0d\x20]")


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as byte planes, compressed: small or slowly rising values take few bytes."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        data = zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)
        out += [np.array([a.itemsize, len(a), len(data)], np.int64).tobytes(), data]
    return b"".join(out)


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        width, n, size = np.frombuffer(data, np.int64, 3, at).tolist()
        raw = zstandard.decompress(data[at + 24 : at + 24 + size], width * n)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(t).ravel())
        at += 24 + size
    return out


def rising(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


class Block(NamedTuple):
    """Texts that are counted at once. A part of a long text doesn't begin, or doesn't end; before: hashes of the words before each text."""

    ids: pa.Array
    texts: pa.Array
    held: np.ndarray
    ends: np.ndarray
    before: np.ndarray


def _cut(text: str, room: int) -> list[bytes]:
    """The text in parts of about room bytes, cut at white space."""
    data, out, at = text.encode(), [], 0
    while len(data) - at > room and (m := _SPACE.search(data, at + room)):
        out.append(data[at : m.start()])
        at = m.end()
    return [*out, data[at:]]


def blocks_of(batches: Iterator[pa.RecordBatch], order: int, room: int = BLOCK_BYTES) -> Iterator[Block]:
    """Batches of doc_id, text, held as blocks of at most room bytes of text."""
    begin = np.full(order - 1, START, np.uint64)
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> Block:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        n = table.num_rows
        return Block(table["doc_id"], table["text"], np.asarray(table["held"].to_numpy(zero_copy_only=False), bool), np.ones(n, bool), np.tile(begin, (n, 1)))

    for batch in batches:
        length = np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0)).astype(np.int64)
        low, n = 0, batch.num_rows
        while low < n:
            if length[low] > room:
                before = begin
                parts = _cut(batch["text"][low].as_py(), room)
                for i, part in enumerate(parts):
                    own = batch.slice(low, 1)
                    yield Block(own["doc_id"], pa.array([part], pa.binary()).cast(pa.string()), np.array([bool(own["held"][0].as_py())]), np.array([i == len(parts) - 1]), before[None])
                    last = [xxhash.xxh64_intdigest(w, 42) for w in part.lower().split()[1 - order :]]
                    before = np.concatenate([before, np.array(last, np.uint64)])[len(last) :]
                low += 1
                continue
            upto = size + np.cumsum(length[low:])
            take = int(np.searchsorted(upto, room, "right"))
            long = np.flatnonzero(length[low:] > room)
            take = min(take, int(long[0])) if len(long) else take
            if take:
                held.append(batch.slice(low, take))
                size, low = int(upto[take - 1]), low + take
            if held and low < n and not (len(long) and length[low] > room):
                yield whole()
                held, size = [], 0
    if held:
        yield whole()


def contexts_of(block: Block, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own: hashes of the block's words, word: place in own of each token, ctx: hashes of contexts of each token by order from 2, text: its text, tokens of each text)."""
    words, n = words_of(block.texts)
    coded = words.dictionary_encode()
    table = coded.dictionary
    data = b"".join(x.as_buffer().to_pybytes() for x in [pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table), "")[0]]) if len(table) else b""
    size = np.asarray(pc.binary_length(table)).astype(np.int64)
    own = np.concatenate([xxh64(data, np.cumsum(size) - size, size), np.array([END], np.uint64)])
    index, ends = np.asarray(coded.indices).astype(np.int64), np.cumsum(n)
    del words, coded, table
    # The words of all texts in a row, each text led by what is before it and, if it ends here, followed by the end.
    word = np.insert(index, ends[block.ends], len(own) - 1)
    tokens = n + block.ends
    at = np.repeat(np.arange(len(n)), tokens)
    row = np.insert(own[word], np.repeat(np.cumsum(tokens) - tokens, order - 1), block.before.ravel())
    place = np.arange(len(word)) + (at + 1) * (order - 1)
    ctx = np.empty((order - 1, len(word)), np.uint64)
    ctx[0] = row[place - 1]
    with np.errstate(over="ignore"):
        for k in range(1, order - 1):
            h = (ctx[k - 1] ^ (row[place - 1 - k] >> _U(7))) * _U(11400714785074694791) + row[place - 1 - k]
            h = (h ^ (h >> _U(32))) * _U(14029467366897019727)
            ctx[k] = h ^ (h >> _U(29))
    return own, word, ctx, at, tokens


class Hot(NamedTuple):
    """Hashes of hot contexts, sorted, and over how many buckets each is dealt."""

    ids: np.ndarray
    splits: np.ndarray

    def find(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id, -1 for those that aren't hot."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)


NO_HOT = Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def block_rows(block: Block, buckets: int, order: int, hot: Hot, with_docs: bool) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """([(bucket, packed n-grams)], tokens of each text). Packed: context hashes, those of their suffixes by order from 2, n-grams of each context,
    words (their own table and places in it), how often training has each n-gram, and with documents its occurrences and for each occurrence
    the text's number, doubled, plus 1 if held out."""
    own, word, ctx, at, tokens = contexts_of(block, order)
    if not with_docs:  # only counts are asked for
        taught = ~block.held[at]
        word, ctx, at = word[taught], ctx[:, taught], at[taught]
    if not len(word):
        return [], tokens
    ids, first_at, entry = np.unique(ctx[-1], return_index=True, return_inverse=True)
    lower = ctx[:-1, first_at]  # each context's suffixes
    bucket = ((ids >> _U(33)) % _U(buckets)).astype(np.int64)
    doc = at.astype(np.uint32) * 2 + block.held[at].astype(np.uint32)
    del ctx, at
    hot_at = hot.find(ids)
    if (hot_at >= 0).any():
        # A hot context is as many contexts as it has buckets.
        t = np.flatnonzero(hot_at[entry] >= 0)
        part = ((own[word[t]] >> _U(20)) % hot.splits[hot_at[entry[t]]].astype(np.uint64)).astype(np.int64)
        made, again = np.unique(entry[t] << 32 | part, return_inverse=True)
        source = made >> 32
        entry[t] = len(ids) + again
        bucket = np.concatenate([bucket, (bucket[source] + (made & 0xFFFFFFFF)) % buckets])
        ids, lower = np.concatenate([ids, ids[source]]), np.concatenate([lower, lower[:, source]], axis=1)
    by_bucket = np.lexsort((ids, bucket))
    place = np.empty(len(ids), np.int64)
    place[by_bucket] = np.arange(len(ids))
    by_hash = np.argsort(own)
    rank = np.empty(len(own), np.int64)
    rank[by_hash] = np.arange(len(own))
    code = place[entry] << 32 | rank[word]
    del entry, word
    by_code = np.argsort(code, kind="stable")
    code, doc = code[by_code], doc[by_code]
    del by_code
    first = np.flatnonzero(np.diff(code, prepend=-1))  # of each n-gram
    gram = code[first]
    del code
    runs = np.diff(np.append(first, len(doc))).astype(np.uint32)
    taught = np.add.reduceat((~doc & 1), first).astype(np.uint32)
    context = gram >> 32
    first_c = np.flatnonzero(np.diff(context, prepend=-1))  # of each context, among n-grams
    used_c = by_bucket[context[first_c]]
    b = bucket[used_c]
    out = []
    for x in np.unique(b):
        lo, hi = np.searchsorted(b, [x, x + 1])
        p_lo, p_hi = first_c[lo], first_c[hi] if hi < len(b) else len(gram)
        o_lo, o_hi = first[p_lo], first[p_hi] if p_hi < len(first) else len(doc)
        used, w_at = np.unique(gram[p_lo:p_hi] & 0xFFFFFFFF, return_inverse=True)
        parts = [rising(ids[used_c[lo:hi]]), lower[:, used_c[lo:hi]].ravel(), np.diff(np.append(first_c[lo:hi], p_hi)).astype(np.uint32)]
        parts += [rising(own[by_hash[used]]), w_at.astype(np.uint32)]
        parts += [runs[p_lo:p_hi], doc[o_lo:o_hi]] if with_docs else [taught[p_lo:p_hi], np.zeros(0, np.uint32)]
        out.append((int(x), pack(*parts)))
    return out, tokens


TABLE = "kind string, bucket int, block long, data binary"
SUMS = 4 + K  # of each document: base, known, seen, open, then n-grams by count 1 to K


def bucket_rows(blobs: list[tuple[int, bytes]], order: int, hot: Hot, with_docs: bool) -> Iterator[tuple[str, int, bytes]]:
    """(kind, block, packed) for one bucket, from all blocks' (block, packed n-grams)."""
    parts = [unpack(x, np.uint64, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32) for _, x in blobs]
    ctx = np.concatenate([np.repeat(np.cumsum(p[0]), p[2]) for p in parts])
    lower = np.concatenate([np.repeat(p[1].reshape(order - 2, len(p[0])), p[2], axis=1) for p in parts], axis=1)
    word = np.concatenate([np.cumsum(p[3])[p[4]] for p in parts])
    runs = np.concatenate([p[5] for p in parts]).astype(np.int64)
    docs = np.concatenate([p[6] for p in parts])
    occurrences = [len(p[6]) for p in parts]
    del parts
    by = np.lexsort((word, ctx))
    sc, sw = ctx[by], word[by]
    new = np.concatenate([[True], (sc[1:] != sc[:-1]) | (sw[1:] != sw[:-1])])
    new_c = np.concatenate([[True], sc[1:] != sc[:-1]])
    gram = np.empty(len(by), np.int32)
    gram[by] = np.cumsum(new, dtype=np.int32) - 1
    context_of = (np.cumsum(new_c, dtype=np.int32) - 1)[new]  # of each distinct n-gram
    contexts, words = sc[new_c], sw[new]
    lower = lower[:, by][:, new_c]
    del by, sc, sw, ctx, word, new, new_c
    trained = np.add.reduceat((~docs & 1).astype(np.int64), np.cumsum(runs) - runs) if with_docs else runs
    c = np.bincount(gram, trained, len(words)).astype(np.int64)
    asked = np.ones(len(contexts), bool)
    if with_docs:
        total = np.bincount(context_of, c, len(contexts)).astype(np.int64)
        small = np.bincount(context_of, (c > 0) & (c <= K), len(contexts)) > 0
        is_hot = hot.find(contexts) >= 0
        asked = (np.bincount(context_of, (c == 0), len(contexts)) > 0) | is_hot
        # Sums for each document of each block.
        at = np.repeat(gram, runs)
        c_at, ctx_at = c[at].astype(np.int32), context_of[at]
        counted = (contexts != START) & ~is_hot if order == 2 else np.zeros(len(contexts), bool)
        base = np.where(counted, np.log10(total + 1.0), 0.0)
        known = counted & (total > 0)
        divisor = np.where(is_hot, 1.0, np.maximum(total + ~small, 1))
        seen = np.where(c > 0, np.log10(np.maximum(c, 1)) - np.log10(divisor[context_of]), 0.0)
        lo = 0
        for (block, _), n in zip(blobs, occurrences, strict=True):
            own, d = slice(lo, lo + n), docs[lo : lo + n] >> 1
            lo += n
            r, h = c_at[own], ctx_at[own]
            heavy = np.flatnonzero(is_hot[h])
            if len(heavy):
                each, back = np.unique(h[heavy].astype(np.int64) << 32 | d[heavy], return_inverse=True)
                yield "hot", block, pack(contexts[each >> 32], (each & 0xFFFFFFFF).astype(np.uint32), np.bincount(back).astype(np.uint32), np.bincount(back, r[heavy] > 0).astype(np.uint32))
            used, d = np.unique(d, return_inverse=True)
            sums = [np.bincount(d, base[h]), np.bincount(d, known[h]), np.bincount(d, seen[at[own]]), np.bincount(d, r == 0)]
            sums += [np.bincount(d, r == k) for k in range(1, K + 1)]
            yield "docs", block, pack(used.astype(np.uint32), *(x if i in (0, 2) else x.astype(np.uint32) for i, x in enumerate(sums)))
            missing = np.flatnonzero(r == 0)
            if len(missing):
                yield "open", block, pack(used[d[missing]].astype(np.uint32), contexts[h[missing]], lower[:, h[missing]].ravel(), words[at[own][missing]])
    kept = c > 0
    types = np.bincount(context_of[kept], minlength=len(contexts))
    full = types > 0
    yield "types", 0, pack(rising(contexts[full]), lower[-1:, full].ravel(), types[full].astype(np.uint32), words[kept], c[kept].astype(np.uint64), asked[full].astype(np.uint8))


def hot_contexts(rows: DataFrame, order: int, buckets: int) -> Hot:
    """Contexts of more than half a bucket's share of all tokens, by a sample of texts; at most 2 * buckets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, order):
            ids, n = np.unique(contexts_of(block, order)[2][-1], return_counts=True)
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], ["h", "n"])

    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0)
    counts = written(some.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "katz-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * F.lit(2 * buckets) > F.lit(total)).collect()
    ids = np.array([x["h"] for x in found], np.int64).view(np.uint64)
    splits = np.array([min(buckets, -(-2 * buckets * x["n"] // total)) for x in found], np.int64)
    by = np.argsort(ids)
    return Hot(ids[by], splits[by])


class Level(NamedTuple):
    """The tables of one order (TABLE), the type of ids, and the totals of its hot contexts."""

    order: int
    model: DataFrame
    id_type: str
    hot: Hot
    hot_total: np.ndarray
    hot_small: np.ndarray


def gathered(docs: DataFrame, held: Column, order: int = ORDER, with_docs: bool = True) -> Level:
    """The tables of one order. docs: doc_id, text; held: not trained on; with_docs: sums and open n-grams for each document too."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 20, max(LEAST_BUCKETS, size // BUCKET_BYTES))
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    hot = hot_contexts(rows, order, buckets)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = 0  # the block of a long text's first part
        for i, block in enumerate(blocks_of(batches, order)):
            made, n = block_rows(block, buckets, order, hot, with_docs)
            number = TaskContext.get().partitionId() << 32 | i
            if with_docs:
                begins = np.all(block.before == START, axis=1)
                home = number if begins[0] else home
                listed = pa.RecordBatch.from_arrays([block.ids, pa.array(block.held), pa.array(n, pa.int64()), pa.array(begins), pa.array([home] * len(n), pa.int64())], ["doc_id", "held", "n", "begins", "home"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, listed.schema) as to:
                    to.write_batch(listed)
                made.append((-1 - number % buckets, sink.getvalue().to_pybytes()))
            give_back()
            for b, data in made:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["bucket", "block", "data"])

    def buckets_of(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        blobs = list(zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True))
        made = [("blocks", k, x) for k, x in blobs] if b < 0 else list(bucket_rows(blobs, order, hot, with_docs))
        give_back()
        return pa.table([pa.array([x[0] for x in made]), pa.array([b] * len(made), pa.int32()), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.binary())], ["kind", "bucket", "block", "data"])

    packed = rows.mapInArrow(blocks, "bucket int, block long, data binary").repartition(min(buckets, 4096), "bucket")
    model = written(packed.groupBy("bucket").applyInArrow(buckets_of, TABLE), f"katz-model-{order}", ("kind",), BATCHES)
    level = Level(order, model, docs.schema["doc_id"].dataType.simpleString(), hot, np.zeros(len(hot.ids), np.int64), np.zeros(len(hot.ids), bool))

    def of_hot(_, data):
        h, _, n, w, c, _ = _types(data)
        at = hot.find(np.repeat(h, n))
        return [at[at >= 0], c[at >= 0], (c <= K)[at >= 0]]

    if len(hot.ids):
        sums = _rows(level, "types", "at long, c long, small boolean", of_hot).groupBy("at").agg(F.sum("c").alias("c"), F.max("small").alias("small"))
        for x in sums.collect():  # at most one row a hot context
            level.hot_total[x["at"]], level.hot_small[x["at"]] = x["c"], x["small"]
    return level


def _rows(level: Level, kind: str, schema: str, function) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"].to_pylist(), strict=True):
                columns = function(block, data)
                for at in range(0, len(columns[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names)
            give_back()

    return level.model.filter(F.col("kind") == kind).select("block", "data").mapInArrow(run, schema)


def _types(data: bytes):
    """contexts, their suffixes, n-grams of each, words, counts, whether open n-grams ask for the context."""
    h, s, n, w, c, asked = unpack(data, np.uint64, np.uint64, np.uint32, np.uint64, np.uint64, np.uint8)
    return np.cumsum(h), s, n.astype(np.int64), w, c.astype(np.int64), asked.astype(bool)


def _cold_words(hot: Hot, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) of a bucket of pairs: its contexts but for the start and hot ones."""
    h, _, n, _, c, _ = _types(data)
    if not len(h):
        return h, c
    own = (h != START) & (hot.find(h) < 0)
    return h[own], np.add.reduceat(c, np.cumsum(n) - n)[own]


def _counts_of_counts(level: Level, counts_in) -> list[int]:
    """Index r: how many are counted r times, r up to K + 1; index 0: all of them. A bucket gives K + 2 numbers."""

    def function(_, data):
        c = counts_in(data)
        return [np.arange(K + 2), np.array([len(c), *((c == r).sum() for r in range(1, K + 2))], np.int64)]

    found = _rows(level, "types", "r long, n long", function).groupBy("r").agg(F.sum("n").alias("n")).collect()
    by = {x["r"]: x["n"] for x in found}
    return [by.get(r, 0) for r in range(K + 2)]


def discounts(n: list[int]) -> list[float]:
    """d_0 to d_K (d_0 unused) from counts of counts."""
    out, tail = [1.0], (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(d: list[float], c: str = "c") -> Column:
    """d_c c."""
    return F.element_at(F.array(*(F.lit(x) for x in [*d[1:], 1.0])), F.least(F.col(c), F.lit(K + 1)).cast("int")) * F.col(c)


def score_documents(docs: DataFrame, held: Column, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; the model of this order learns from those not held."""
    with scratch(docs.sparkSession):
        levels = {k: gathered(docs, held, k, with_docs=k in (2, order)) for k in range(2, order + 1)}
        return written(_scored(levels, order), "katz-scores", result=True)


def _scored(levels: dict[int, Level], order: int) -> DataFrame:
    pairs, top = levels[2], levels[order]
    spark, pair_hot = pairs.model.sparkSession, pairs.hot

    def listed(block, data):
        t = pa.ipc.open_stream(data).read_all()
        return [np.full(len(t), block), np.arange(len(t), dtype=np.int32), *(t[c].combine_chunks() for c in ("doc_id", "held", "n", "begins", "home"))]

    docs_of = _rows(pairs, "blocks", f"block long, doc int, doc_id {pairs.id_type}, held_out boolean, n_tokens long, begins boolean, home long", listed)
    trained = docs_of.filter(~F.col("held_out")).agg(F.count_if("begins").alias("docs"), F.sum("n_tokens").alias("tokens")).first()
    n_docs, n_train = trained["docs"], trained["tokens"] or 0
    # Words: contexts of pairs, but for the start; the end is a word of n_docs occurrences.
    counts = _counts_of_counts(pairs, lambda data: _cold_words(pair_hot, data)[1])
    hot_words = [(int(h), int(n)) for h, n in zip(pairs.hot.ids.view(np.int64), pairs.hot_total, strict=True) if h != START and n]
    for n in [n for _, n in hot_words] + [n_docs] * (n_docs > 0):
        counts[0] += 1
        if n <= K + 1:
            counts[n] += 1
    n_words, d1 = counts[0], discounts(counts)
    d = {k: discounts(_counts_of_counts(level, lambda data: _types(data)[4])) for k, level in levels.items()}
    # What unseen words have together, and by what seen ones are scaled if Good-Turing leaves nothing.
    left = sum(counts[r] * r * (1 - d1[r]) for r in range(1, K + 1)) / n_train if n_train else 1.0
    scale = 1.0 if left > 0 else n_train / (n_train + 1)
    unseen = left if left > 0 else 1 / (n_train + 1)

    def words_in(_, data):
        h, c = _cold_words(pair_hot, data)
        return [h.view(np.int64), c]

    more = hot_words + [(END, n_docs)] * (n_docs > 0)
    words = _rows(pairs, "types", "w long, c long", words_in)
    words = words.union(spark.createDataFrame(more, "w long, c long")) if more else words
    words_p = words.select("w", (_discounted(d1) / F.lit(float(max(n_train, 1))) * F.lit(scale)).alias("p"))

    def types_in(asked_only: bool):
        def function(_, data):
            h, s, n, w, c, asked = _types(data)
            keep = np.repeat(asked | (not asked_only), n)
            return [x[keep] if x.dtype == np.int64 else x[keep].view(np.int64) for x in (np.repeat(h, n), np.repeat(s, n) if len(s) else np.repeat(h, n), w, c)]

        return function

    def grams(level: Level, asked_only: bool = False) -> DataFrame:
        """h, s, w, c of each n-gram that training has; s: the context's suffix."""
        return _rows(level, "types", "h long, s long, w long, c long", types_in(asked_only))

    def divisor(total: Column, small: Column) -> Column:
        return total + F.when(small, 0).otherwise(1)

    def totals(level: Level) -> DataFrame:
        """h, div of each context."""
        return grams(level).groupBy("h").agg(divisor(F.sum("c"), F.bool_or(F.col("c") <= K)).alias("div"))

    def p_seen(level: Level, asked: DataFrame) -> DataFrame:
        """h, w, p: the probability of each n-gram of a context in asked(h)."""
        own = grams(level).join(asked, "h", "left_semi")
        return own.join(totals(level), "h").select("h", "w", (_discounted(d[level.order]) / F.col("div")).alias("p"))

    def weights(level: Level, asked: DataFrame | None) -> DataFrame:
        """h, alpha of the contexts in asked(h), or else of those that the level's own open n-grams ask for."""
        own = grams(level, True) if asked is None else grams(level).join(asked, "h", "left_semi")
        if level.order == 2:
            own = own.join(words_p, "w")
        else:
            lower = p_seen(levels[level.order - 1], own.select(F.col("s").alias("h")).distinct())
            own = own.join(lower.withColumnRenamed("h", "s"), ["s", "w"])
        total, small = F.sum("c"), F.bool_or(F.col("c") <= K)
        rest = F.when(small, F.sum(F.col("c") - _discounted(d[level.order]))).otherwise(1.0)
        return own.groupBy("h").agg((rest / divisor(total, small) / (1 - F.sum("p"))).alias("alpha"))

    def open_in(block, data):
        doc, h, lower, w = unpack(data, np.uint32, np.uint64, np.uint64, np.uint64)
        return [np.full(len(doc), block), doc.astype(np.int32), *(x.view(np.int64) for x in (*lower.reshape(order - 2, len(h)), h, w))]

    contexts = ", ".join(f"h{k} long" for k in range(2, order + 1))
    opened = _rows(top, "open", f"block long, doc int, {contexts}, w long", open_in).withColumn("t", F.lit(0.0))
    parts = []
    for k in range(order, 1, -1):
        own, asked = f"h{k}", None
        if k < order:
            opened = written(opened, "katz-open")
            asked = opened.select(F.col(own).alias("h")).distinct()
            opened = opened.join(p_seen(levels[k], asked).withColumnRenamed("h", own), [own, "w"], "left")
            parts.append(opened.filter("p is not null").select("block", "doc", (F.col("t") + F.log10("p")).alias("t")))
            opened = opened.filter("p is null").drop("p")
        alpha = written(weights(levels[k], asked), "katz-alpha")
        opened = opened.join(alpha.withColumnRenamed("h", own), own, "left").withColumn("t", F.col("t") + F.log10(F.coalesce("alpha", F.lit(1.0)))).drop("alpha", own)
    opened = opened.join(words_p, "w", "left").select("block", "doc", (F.col("t") + F.log10(F.coalesce("p", F.lit(unseen)))).alias("t"))
    for part in parts:
        opened = opened.union(part)
    opened = opened.groupBy("block", "doc").agg(F.sum("t").alias("open_sum"))

    def sums_of(level: Level) -> DataFrame:
        """block, doc, base, known, seen: what the buckets and the hot contexts give each document."""
        logs = np.array([math.log10(x) for x in d[level.order][1:]])
        log_total, log_divisor = np.log10(level.hot_total + 1.0), np.log10(np.maximum(level.hot_total + ~level.hot_small, 1))
        word, counted, hot = (level.hot.ids != START) & (level.order == 2), level.hot_total > 0, level.hot

        def summed(table: pa.Table) -> pa.Table:
            total = np.zeros((3, 0))

            def room(n: int) -> None:
                nonlocal total
                if n > total.shape[1]:
                    total = np.concatenate([total, np.zeros((3, n - total.shape[1]))], axis=1)

            for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
                if kind == "hot":
                    h, doc, n, seen = unpack(data, np.uint64, np.uint32, np.uint32, np.uint32)
                    at = hot.find(h)
                    room(int(doc.max()) + 1)
                    for row, x in enumerate((np.where(word[at], n * log_total[at], 0.0), n * (word & counted)[at], -(seen * log_divisor[at]))):
                        total[row] += np.bincount(doc, x, total.shape[1])
                    continue
                doc, *sums = unpack(data, np.uint32, *(np.float64 if i in (0, 2) else np.uint32 for i in range(SUMS)))
                room(int(doc[-1]) + 1)
                total[0, doc] += sums[0]
                total[1, doc] += sums[1]
                total[2, doc] += sums[2] + sum(sums[3 + k] * logs[k - 1] for k in range(1, K + 1))
            n = total.shape[1]
            return pa.table([pa.array([table["block"][0].as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(total[0]), pa.array(total[1].astype(np.int64)), pa.array(total[2])], ["block", "doc", "base", "known", "seen"])

        return level.model.filter("kind in ('docs', 'hot')").select("kind", "block", "data").groupBy("block").applyInArrow(summed, "block long, doc int, base double, known long, seen double")

    sums = sums_of(pairs)
    if order > 2:
        sums = sums.drop("seen").join(sums_of(top).select("block", "doc", "seen"), ["block", "doc"])
    parts_of = docs_of.join(sums, ["block", "doc"], "left").join(opened, ["block", "doc"], "left")
    # The parts of a long text make one document.
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n, known = F.sum("n_tokens"), total("known") + F.lit(int(n_docs > 0))
    base = total("base") + F.lit(math.log10(n_docs + 1)) - n * F.lit(math.log10(n_train + n_words + 1))
    out = parts_of.groupBy("home", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), n.alias("n_tokens"), known.alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), base.cast("double").alias("base_score"), (total("seen") + total("open_sum")).cast("double").alias("score"),
    )
    return out.drop("home", "doc")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents under a model of those whose crc32 of the id isn't 2 modulo 7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2)
