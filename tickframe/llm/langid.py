"""Language identification by rank-order profiles.

A profile is the list of the most frequent 1- to 3-grams of letters, in order. A text's own profile is compared to each language's by
the out-of-place distance: for each of its n-grams the difference of the two ranks, or the largest one if the language lacks it. The
nearest language is predicted.

Fitting counts n-grams in a bounded sample of labelled rows: of each language the `FIT_DOCS` documents with the least hash of their text (the bound is a
parameter; up to about twice as many are taken). Profiles have PROFILE rows a language; they are the only thing sent to all tasks, checked to be at
most MOST_LANGUAGES. Predicting reads whole texts, each in its own row, with no shuffle.

Defined cases: a null text or one without a letter is `und` with score 0; without any learned language every text is `und`; ties go to the
language that sorts first; empty tables give empty results; other columns are carried on by `filter_documents`, which also names the predicted
language where `lang` is null.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, rows_bounded

PROFILE = 400
FIT_DOCS = 2_000
MOST_LANGUAGES = 1_000
#: A text is rejected by the filter below this score: 1 minus the distance as a share of the largest there can be. Of 3,334 documents of sf0.1 the
#: least has 0.378; texts of a language that isn't learned, encoded data and random letters have 0.24 or less.
LEAST_SCORE = 0.3

_OTHER = re.compile(r"[\W\d_]+")
#: Python's word characters have number signs such as ² and ½ (categories Nl and No) beside letters and digits.
_SIGNS = np.array([unicodedata.category(chr(c)) in ("Nl", "No") for c in range(sys.maxunicode + 1)])
_BOUND = ord("_")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the 1- to 3-grams of the lower-cased text, words bounded by _; an n-gram of several words doesn't occur."""
    letters = _OTHER.sub("_", f"_{text.lower()}_")
    c = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if (signs := _SIGNS[c]).any():
        c = np.where(signs, _BOUND, c)
        c = c[np.concatenate([[True], (c[1:] != _BOUND) | (c[:-1] != _BOUND)])]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = c[1:-1]
    one, two, three = c, (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.unique(np.concatenate([one[one != _BOUND], two | 1 << 62, three[inner != _BOUND] | -(1 << 63)]), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The codes of the n largest counts, in order; equal counts by code."""
    return codes[np.lexsort((codes, -counts))[:n]]


class Profiles:
    """Ranks by language in one sorted table."""

    def __init__(self, by_language: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(by_language), size
        self.codes = np.unique(np.concatenate([*by_language.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            own = by_language[name]
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, own)
        found = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own) if len(self.codes) else np.zeros(len(own), bool)
        ranks = self.ranks[np.where(found, at, len(self.codes))]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None]))
        return apart.sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names:
            return "und", 0.0
        own = top(*grams(text), self.size)
        if not len(own):
            return "und", 0.0
        d = self.distances(own)
        k = int(d.argmin())
        return self.names[k], float(1 - d[k] / (self.size * len(own)))


def fit(labelled: DataFrame, docs_each: int = FIT_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles from rows (doc_id, text, lang); rows without text or lang teach nothing.

    The sample is chosen by a hash of the text alone, so that no text moves and reruns agree.
    """
    spark = labelled.sparkSession
    h = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), F.col("text")), 1)
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.floor(F.log2(h.cast("double") + 1)).cast("int").alias("e"))
    # Rows by the binary order of their hash: 64 counts a language. The least order whose rows suffice gives at most about twice the bound.
    tally = rows.groupBy("lang", "e").count()
    if not rows_bounded(tally, 65 * MOST_LANGUAGES):
        raise ValueError(f"more than {MOST_LANGUAGES} languages; lang isn't a language column")
    limits: dict[str, int] = {}
    upto: dict[str, int] = {}
    for r in tally.orderBy("lang", "e").collect():
        if upto.get(r["lang"], 0) < docs_each:
            limits[r["lang"]] = r["e"]
            upto[r["lang"]] = upto.get(r["lang"], 0) + r["count"]
    if not limits:
        return Profiles({}, size)
    limit = spark.createDataFrame(list(limits.items()), "l string, last int")
    chosen = rows.join(F.broadcast(limit), (F.col("lang") == F.col("l")) & (F.col("e") <= F.col("last"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(text))
        for lang, parts in found.items():
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    counts = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= size).select("lang", "code", "rank").collect()
    table: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        table.setdefault(r["lang"], []).append(r["code"])
    return Profiles({k: np.array(v, np.int64) for k, v in table.items()}, size)


def predict(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, lang_pred, score of each document."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x) for x in batch["__text"].to_pylist()]
            columns = [batch[k] for k in keep] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def filter_documents(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE, wanted: Collection[str] | None = None) -> DataFrame:
    """The documents in a language that is wanted (all learned ones if none is named) and recognised with a score of least, with the columns
    they came with; a null `lang` becomes the predicted language."""
    schema = docs.schema
    wanted = frozenset(profiles.names if wanted is None else wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch["text"]]
            if "lang" in batch.schema.names:
                at = batch.schema.get_field_index("lang")
                named = pc.coalesce(batch["lang"], pa.array([f[0] for f in found], batch.schema.field(at).type))
                batch = batch.set_column(at, batch.schema.field(at), named)
            yield batch.filter(pa.array([lang in wanted and score >= least for lang, score in found], pa.bool_()))
            give_back()

    return docs.mapInArrow(run, schema)


def held_out(docs: DataFrame):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the language of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = fit(docs.filter(~held_out(docs)))
    return predict(docs.withColumn("held_out", held_out(docs)), profiles, ("doc_id", "held_out"))
