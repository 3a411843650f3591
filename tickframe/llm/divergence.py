"""Source divergence audit: how far each source's use of words lies from the other sources of its language, and which words make the difference.

Two passes over the texts. The first counts exact document frequencies by language; terms in at least LEAST_DOCS documents are kept. The second
recounts occurrences of the kept terms with an Aho-Corasick automaton a language: texts are folded to terms with one delimiter around each, and
the automaton holds the kept terms with a delimiter on both sides, so that a match is a whole term and neighbours share a delimiter.

The vocabulary reaches the tasks in parts of about PART_BYTES, one pass over the texts for each part, so that no task holds more than a part,
however many terms are kept. Both passes count within a task before anything is shuffled: rows that leave it are sums by term, so that a hot
source or language costs no more than another.

Postings are sparse: (lang, source, term, count) with count > 0 only. A pair's divergence is what it would be if neither source had any term
(the terms times the distance of the two floors) with corrections: from a source's own counts against the other's floor (postings are grouped by
count first), and from the terms that both have. Only the latter pair sources term by term; they are added up within blocks of terms before they
leave a task.

Arithmetic is exact: probabilities are integers, worked out in decimals of 38 digits.

Defined cases: null text, lang and source count as empty; a group without terms, and a language that keeps none, is in the result (pairs of a
language that keeps no term have value 0); a language with one source has no pairs; repeated rows count as often as they occur; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, scratch, written

#: Documents of a language that a kept term occurs in, at least.
LEAST_DOCS = 30
#: Added to every count; what probabilities are counted in.
SMOOTH, SCALE = 5, 1_000_000_000
#: Rows of a group's term part.
TOP_TERMS = 50
#: UTF-8 bytes of kept terms in one pass, about, and sums that a task holds before they leave it.
PART_BYTES = 2_000_000
HELD = 1 << 20
#: Bytes of text that are folded at once; a longer text goes alone.
SLICE = 1 << 22
#: Postings of a block of terms, about.
BLOCK = 1 << 18

#: ASCII letters in lower case, other bytes of ASCII as a space, bytes beyond it as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and every character outside of terms as a space."""
    if not len(texts):
        return texts
    texts = pa.concat_arrays([texts.slice(0, 0), pc.fill_null(texts, "")])  # a copy that starts at 0 and has no other text's bytes
    _, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_FOLD))
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, data])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    part = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0)).astype(np.int64)) // SLICE
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return (batch.slice(a, b - a) for a, b in zip(at, at[1:], strict=False) if b > a)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, docs: in how many documents of the language a term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in _slices(batch):
                split = pc.ascii_split_whitespace(folded(part["text"]))
                flat, cuts = split.flatten(), np.asarray(split.offsets)
                coded = flat.dictionary_encode()
                terms, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
                own = np.repeat(np.arange(len(part)), np.diff(cuts))
                each = np.unique(own * (len(terms) + 1) + code)
                langs = part["lang"].dictionary_encode()
                by = np.asarray(langs.indices)[each // (len(terms) + 1)].astype(np.int64)
                pair, n = np.unique(by * (len(terms) + 1) + each % (len(terms) + 1), return_counts=True)
                made = [langs.dictionary.take(pa.array(pair // (len(terms) + 1))), terms.take(pa.array(pair % (len(terms) + 1))), pa.array(n.astype(np.int64))]
                parts.append(pa.table(made, ["lang", "term", "docs"]))
            if parts:
                summed = pa.concat_tables(parts).group_by(["lang", "term"]).aggregate([("docs", "sum")])
                summed = summed.filter(pc.not_equal(summed["term"], "")).rename_columns(["lang", "term", "docs"])
                yield from summed.select(["lang", "term", "docs"]).combine_chunks().to_batches()
            give_back()

    return _rows(docs).select("lang", "text").mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def parted(kept: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """(kept with a column part, number of parts): by hash, so many that none has more than twice part_bytes of terms (but for a single term)."""
    size = F.octet_length("term") + 1
    total = kept.agg(F.sum(size).alias("n")).first()["n"] or 0
    n = max(1, -(-total // part_bytes))
    while True:
        out = kept.withColumn("part", F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int"))
        most = out.groupBy("part").agg(F.sum(size).alias("n"), F.count("*").alias("c")).filter("c > 1").agg(F.max("n").alias("m")).first()["m"] or 0
        if most <= 2 * part_bytes:
            return out, n
        n *= 2


class Automata:
    """An automaton a language over terms with a delimiter on both sides, made when the language is first met."""

    def __init__(self, terms: list[tuple[str, str]]):
        self.terms: dict[str, list[str]] = {}
        for lang, term in terms:
            self.terms.setdefault(lang, []).append(term)
        self.made: dict[str, ahocorasick.Automaton] = {}

    def count(self, lang: str, text: str) -> Counter:
        """Occurrences by number of the term; text: folded, with a delimiter at both ends."""
        if lang not in self.terms:
            return Counter()
        if lang not in self.made:
            made = self.made[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(self.terms[lang]):
                made.add_word(f" {term} ", i)
            made.make_automaton()
        return Counter(map(itemgetter(1), self.made[lang].iter(text)))


#: This worker's automata, by the name of their pass: the next task of the pass has them already.
_here: dict[str, Automata] = {}


def occurrences(docs: DataFrame, kept: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, source, term, n > 0: how often the kept terms (lang, term) occur in each group, as a table; one pass over the texts for each part."""
    spark = docs.sparkSession
    rows, (parts, n) = _rows(docs), parted(kept, part_bytes)
    found = []
    for k in range(n):
        # A part is bounded (parted sees to it), whatever the number of kept terms.
        terms = [(r["lang"], r["term"]) for r in parts.filter(F.col("part") == k).select("lang", "term").collect()]
        sent, name = spark.sparkContext.broadcast(terms), uuid.uuid4().hex
        found.append(written(_counted(rows, sent, name).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "audit-occurrences"))
        sent.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _counted(rows: DataFrame, sent, name: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _here:
            _here.clear()
            _here[name] = Automata(sent.value)
        automata, sums = _here[name], {}
        for batch in batches:
            for part in _slices(batch):
                groups: dict[tuple[str, str], list[str]] = {}
                for lang, source, text in zip(part["lang"].to_pylist(), part["source"].to_pylist(), folded(part["text"]).to_pylist(), strict=True):
                    groups.setdefault((lang, source), []).append(text)
                for group, texts in groups.items():
                    sums.setdefault(group, Counter()).update(automata.count(group[0], f" {' '.join(texts)} "))
            if sum(map(len, sums.values())) > HELD:
                yield _sums(automata, sums)
                sums = {}
        yield _sums(automata, sums)
        give_back()

    return rows.mapInArrow(count, "lang string, source string, term string, n long")


def _sums(automata: Automata, sums: dict[tuple[str, str], Counter]) -> pa.RecordBatch:
    langs, sources = ([g[k] for g, c in sums.items() for _ in c] for k in (0, 1))
    terms = [automata.terms[g[0]][i] for g, c in sums.items() for i in c]
    n = list(chain.from_iterable(c.values() for c in sums.values()))
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.string()), pa.array(n, pa.int64())], ["lang", "source", "term", "n"])


def share(n: str, total: str, terms: str) -> str:
    """SQL: p of a count among a total over so many kept terms, as a long."""
    whole = "decimal(38, 0)"
    return f"cast(1 + (cast({SCALE} as {whole}) * (cast({n} as {whole}) + {SMOOTH})) div (cast({total} as {whole}) + {SMOOTH} * cast({terms} as {whole})) as bigint)"


def shared_terms(postings: DataFrame, blocks: int) -> DataFrame:
    """lang, a, b, value: for sources a < b, summed over the terms that both have, what the distance of their p differs by from the sum of the
    corrections that each makes on its own. postings: lang, source, term, p, floor."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("term", "ascending"), ("source", "ascending")])
        names = table["source"].combine_chunks().dictionary_encode()
        order = np.argsort(np.argsort(np.array(names.dictionary.to_pylist(), object), kind="stable"), kind="stable")
        source = order[np.asarray(names.indices)] if len(order) else np.zeros(0, np.int64)
        term = np.asarray(table["term"].combine_chunks().dictionary_encode().indices)
        p, floor = np.asarray(table["p"].combine_chunks()), np.asarray(table["floor"].combine_chunks())
        keys, values = [], []
        for step in range(1, len(term)):
            at = np.flatnonzero(term[step:] == term[:-step])
            if not len(at):
                break
            to = at + step
            more = np.abs(p[at] - p[to]) - np.abs(p[at] - floor[to]) - np.abs(floor[at] - p[to]) + np.abs(floor[at] - floor[to])
            low, high = np.minimum(source[at], source[to]), np.maximum(source[at], source[to])
            pair, place = np.unique(low.astype(np.int64) * len(order) + high, return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, place, more)
            keys.append(pair)
            values.append(total)
        pairs, place = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, np.concatenate([np.zeros(0, np.int64), *values]))
        ranked = pa.array(sorted(names.dictionary.to_pylist()), pa.string())
        lang = pa.array([table["lang"][0].as_py()] * len(pairs), pa.string())
        return pa.table([lang, ranked.take(pa.array(pairs // max(len(order), 1))), ranked.take(pa.array(pairs % max(len(order), 1))), pa.array(total)], ["lang", "a", "b", "value"])

    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")
    made = postings.select("lang", "source", "term", "p", "floor", block).groupBy("lang", "block").applyInArrow(lambda t: run(t.drop_columns(["block"])), "lang string, a string, b string, value long")
    return made.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def own_terms(pairs: DataFrame, spread: DataFrame) -> DataFrame:
    """lang, source, item, own: what the source's postings differ by from the item's floor, less what its floor would. spread: the source's
    postings by p, which times many have; sorted with running sums, they answer each floor by one search."""

    def run(others: pa.Table, own: pa.Table) -> pa.Table:
        if not own.num_rows or not others.num_rows:
            return others.select(["lang", "source", "item"]).append_column("own", pa.array(np.zeros(others.num_rows, np.int64)))
        own = own.sort_by("p")
        p, times = np.asarray(own["p"].combine_chunks()), np.asarray(own["times"].combine_chunks())
        upto, mass = np.concatenate([[0], np.cumsum(times)]), np.concatenate([[0], np.cumsum(p * times)])
        other = np.asarray(others["other"].combine_chunks())
        at = np.searchsorted(p, other)
        apart = other * upto[at] - mass[at] + (mass[-1] - mass[at]) - other * (upto[-1] - upto[at])
        value = apart - upto[-1] * np.abs(own["floor"][0].as_py() - other)
        return others.select(["lang", "source", "item"]).append_column("own", pa.array(value))

    return pairs.groupBy("lang", "source").cogroup(spread.groupBy("lang", "source")).applyInArrow(run, "lang string, source string, item string, own long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank. part `pair`: every other source of the language by divergence. part `term`: the kept terms that a
    group uses more than its language does, the first `top` by the difference."""
    with scratch(docs.sparkSession):
        groups = written(_rows(docs).select("lang", "source").distinct(), "audit-groups")
        kept = written(document_frequencies(docs).filter(F.col("docs") >= least_docs).select("lang", "term"), "audit-kept")
        counts = occurrences(docs, kept, part_bytes)
        terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
        sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        # v is null where a language keeps no term: it has no p at all.
        groups = groups.join(terms, "lang", "left").join(sizes, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
        groups = written(groups.withColumn("floor", F.expr(f"if(v is null, null, {share('0', 'total', 'v')})")), "audit-floors")
        p = F.expr(share("n", "total", "v"))
        postings = written(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", p.alias("p"), "floor"), "audit-postings")
        whole = postings.groupBy("lang", "term").agg(F.sum("n").alias("n"))
        totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("v").alias("v"))
        whole = whole.join(totals, "lang").select("lang", "term", F.expr(share("n", "total", "v")).alias("q"))
        used = postings.join(whole, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

        both = shared_terms(postings, max(1, -(-postings.count() // BLOCK)))
        other = groups.select("lang", F.col("source").alias("item"), F.col("floor").alias("other"))
        pairs = groups.select("lang", "source", "v", "floor").join(other, "lang").filter("source <> item")
        alone = own_terms(pairs, postings.groupBy("lang", "source", "floor", "p").agg(F.count("*").alias("times")))
        mirrored = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("theirs"))
        both = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
        on = ["lang", "source", "item"]
        pairs = pairs.join(alone, on, "left").join(mirrored, on, "left").join(both, on, "left")
        value = F.expr("coalesce(v * abs(floor - other), 0) + coalesce(own, 0) + coalesce(theirs, 0) + coalesce(value, 0)")
        pairs = pairs.select("lang", "source", "item", value.alias("value"))

        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
        used = used.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
        columns = ["lang", "source", "part", "item", "value", "rank"]
        return written(pairs.select(columns).union(used.select(columns)), "audit-result", result=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
c AS (SELECT g.lang, g.source, t.term, coalesce(n, 0)::HUGEINT AS n FROM grp g JOIN kept t USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p FROM c JOIN v USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) z
    ON z.lang = a.lang AND z.s = a.source AND z.t = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 50)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""
