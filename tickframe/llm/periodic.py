"""Periodic runs of words: maximal stretches that repeat with a period, found by Karp-Miller-Rosenberg naming.

Naming: name k of a place stands for the 2^k words from there on; a level pairs names of the level below and numbers the different pairs. Names
are told apart by document, and a place whose name occurs only once in its document has none from there on: no longer stretch from it can be
equal to another. So levels end where no repetition is left, and cost follows what repeats.

Candidates: a run of period p and at least 2p words holds two neighbouring points of the grid 0, p, 2p, ..., so every such pair of points with
an equal word is extended to both sides by descending name levels (each level is tried once, since what is left is always less than twice its
length). Nothing is hashed and no suffix is sorted. Of stretches found under several periods the least one is the smallest period: two periods
of a stretch of twice the greater one have their greatest common divisor as a period.

Documents are put together to slices of about SLICE words and handled at once in NumPy; a longer one goes alone. Memory of a slice: 4 bytes a word and level.

Defined cases: null and empty texts, and texts without words, have no runs and collapse to the empty text; repeated rows are rows of their own;
null ids stay; other columns are left out unless they are named in keep; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, give_back, sql_text

#: Fewest words of a run.
LEAST = 12
#: Words that are handled at once, and candidates.
SLICE = 1 << 19
CANDIDATES = 1 << 20

RUNS = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")]))


def name_levels(words: np.ndarray, owner: np.ndarray, longest: int) -> list[np.ndarray]:
    """Level k at place i: the name of the 2^k words from i on, within one owner; below 0 where no other place of that owner has it."""
    levels: list[np.ndarray] = []
    at = np.arange(len(words))
    pairs = owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    while len(at):
        _, name, count = np.unique(pairs, return_inverse=True, return_counts=True)
        again = count[name] > 1
        at, name = at[again], name[again]
        if not len(at):
            break
        level = np.full(len(words), -1, np.int32)
        level[at] = name
        levels.append(level)
        step = 1 << (len(levels) - 1)
        if step * 2 > longest:
            break
        inside = at + step < len(words)
        at = at[inside]
        # Names are told apart by owner, so that equal pairs lie in one document; a pair that reaches into the next one is cut off here.
        at = at[(level[at + step] >= 0) & (owner[at] == owner[at + step])]
        pairs = level[at].astype(np.int64) * (int(level.max()) + 1) + level[at + step]
    return levels


def extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal words from a and b on, equal words before them); a < b lie in documents from low to high."""
    ahead, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        level, step = levels[k], 1 << k
        x, y = a + ahead, b + ahead
        ok = np.flatnonzero(y + step <= high)
        same = level[x[ok]]
        ok = ok[(same >= 0) & (same == level[y[ok]])]
        ahead[ok] += step
        x, y = a - back - step, b - back - step
        ok = np.flatnonzero(x >= low)
        same = level[x[ok]]
        ok = ok[(same >= 0) & (same == level[y[ok]])]
        back[ok] += step
    return ahead, back


def grid_pairs(lengths: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, document) of the grid's points that have a next one, some CANDIDATES at a time, for periods up to half of a document."""
    order = np.argsort(-lengths, kind="stable")
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    sorted_lengths = -lengths[order]
    for p in range(1, int(lengths.max(initial=0)) // 2 + 1):
        docs = order[: np.searchsorted(sorted_lengths, -2 * p, side="right")]
        for low in range(0, len(docs), CANDIDATES):
            own = docs[low : low + CANDIDATES]
            points = (lengths[own] - 1) // p
            which = np.repeat(np.arange(len(own)), points)
            place = begins[own][which] + (np.arange(len(which)) - np.repeat(np.cumsum(points) - points, points)) * p
            held.append((place, np.full(len(which), p), own[which]))
            n += len(which)
            if n >= CANDIDATES:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def runs_of(words: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, length, smallest period) of all runs, by document, start and period. words: numbers of all documents' words in a row."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    levels = name_levels(words, owner, int(lengths.max(initial=0)))
    found = [np.zeros((4, 0), np.int64)]
    for a, p, doc in grid_pairs(lengths, begins) if levels else ():
        same = levels[0][a]
        ok = np.flatnonzero((same >= 0) & (same == levels[0][a + p]))
        a, p, doc = a[ok], p[ok], doc[ok]
        ahead, back = extend(levels, a, a + p, begins[doc], ends[doc])
        length = ahead + back + p
        ok = (ahead + back >= p) & (length >= least)
        found.append(_least_periods(np.stack([doc[ok], a[ok] - back[ok] - begins[doc[ok]], length[ok], p[ok]])))
    doc, start, length, period = _least_periods(np.concatenate(found, axis=1))
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def _least_periods(found: np.ndarray) -> np.ndarray:
    """Of equal stretches (document, start, length, period) the one with the least period."""
    found = found[:, np.lexsort(found[::-1])]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:3, 1:] != found[:3, :-1]).any(axis=0)
    return found[:, new]


def _repeated_words(total: int, begins: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each word lies in some run after that run's first period."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, begins[doc] + start + period, 1)
    np.add.at(change, begins[doc] + start + length, -1)
    return np.cumsum(change)[:-1] > 0


def _slice_of(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, cuts = split.flatten(), np.asarray(split.offsets)
    full = np.asarray(pc.binary_length(flat)) > 0
    upto = np.concatenate([[0], np.cumsum(full)])[cuts - cuts[0]]
    flat, lengths = flat.filter(pa.array(full)), np.diff(upto)
    words = np.asarray(flat.dictionary_encode().indices)
    doc, start, length, period = runs_of(words, lengths, least)
    kept = ~_repeated_words(len(words), upto[:-1], doc, start, length, period)
    after = np.concatenate([[0], np.cumsum(kept)])[upto]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(after, pa.int32()), flat.filter(pa.array(kept))), " ")
    rows = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    bounds = np.searchsorted(doc, np.arange(len(lengths) + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows), collapsed


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least: int = LEAST) -> DataFrame:
    """keep, runs (start, length and smallest period in words, by start and period) and collapsed: the text without the words that repeat
    a run's first period, joined by one space."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("runs", RUNS).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["__text"]
            # A word and its space take two bytes or more.
            part = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)) // (6 * SLICE)
            for low, high in _cuts(part):
                runs, collapsed = _slice_of(texts.slice(low, high - low), least)
                yield pa.RecordBatch.from_arrays([*(batch[k].slice(low, high - low) for k in keep), runs, collapsed], [*keep, "runs", "collapsed"])
            give_back()

    return rows.mapInArrow(run, schema)


def _cuts(part: np.ndarray) -> Iterator[tuple[int, int]]:
    """The bounds of stretches of equal numbers."""
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return ((a, b) for a, b in zip(at, at[1:], strict=False) if b > a)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a tenth of them (crc32 of the id) with a tail made periodic: the words from a = g % n on repeat the first
    p = 1 + floor((n - a) / (3 + g % 8)) of them, g a tenth of the crc32. A null id plants nothing."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.select("doc_id", "text", F.expr("if(h % 10 = 0, h div 10, null)").alias("g"))
    # Only of the documents that are changed; the words are a column of their own, evaluated once.
    rows = rows.select("doc_id", "text", "g", F.expr(f"if(g is not null, regexp_extract_all(coalesce(text, ''), {sql_text(WORD)}, 0), null)").alias("w"))
    rows = rows.select("doc_id", "text", "g", "w", F.expr("cast(if(size(w) > 0, g % size(w), 0) as int)").alias("a"))
    rows = rows.select("doc_id", "text", "w", "a", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)").alias("p"))
    made = F.expr("array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((size(w) - a) div p + 1 as int)))), 1, size(w)), ' ')")
    return rows.select("doc_id", F.when(F.expr("w is not null and size(w) > 0"), made).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the runs of every document, a tenth of them with planted ones; digests of all runs and of the collapsed text."""
    rows = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    longest = F.expr("aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (m, r) -> if(m is null or r.length > m.length, r, m))")
    rows = rows.select("doc_id", "runs", "collapsed", longest.alias("r"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    every = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("r.start").alias("start"), F.col("r.length").alias("length"), F.col("r.period").alias("period"),
        F.expr("1000 * r.length div r.period").alias("exponent_milli"), F.sha2(every.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
