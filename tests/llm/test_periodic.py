"""Periodic runs against their definition, word by word."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tickframe.llm import periodic
from tickframe.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain_runs(words, least=12):
    """Every maximal stretch under every period; of equal stretches the least period."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                best.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in best.items())


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs))


def samples():
    rng = random.Random(7)
    yield []
    yield ["a"] * 300
    yield list("ab" * 40 + "c" + "ab" * 40)
    fib = ["a", "b"]
    while len(fib) < 200:
        fib, last = fib + fib[: len(fib) * 5 // 8], fib
    yield fib
    for _ in range(120):
        n, letters = rng.randint(1, 160), rng.choice(["ab", "abc", "abcdefghij"])
        words = [rng.choice(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            for i in range(a + p, min(n, a + rng.randint(1, 5) * p)):
                words[i] = words[i - p]
        yield words


@pytest.mark.parametrize("least", [12, 2])
def test_runs_against_the_definition(least):
    every = list(samples())
    numbers = {w: i for i, w in enumerate(sorted({w for x in every for w in x}))}
    flat = np.array([numbers[w] for x in every for w in x])
    doc, *runs = periodic.runs_of(flat, np.array([len(x) for x in every]), least)
    got = list(zip(doc.tolist(), *(c.tolist() for c in runs), strict=True))
    assert got == [(d, *r) for d, x in enumerate(every) for r in plain_runs(x, least)]


def test_slices_and_small_blocks(spark, monkeypatch):
    """Texts that are dealt over several slices and blocks of candidates; nulls, white space, repeated rows, clashing columns."""
    monkeypatch.setattr(periodic, "CANDIDATES", 50)
    every = [" \t".join(x) for x in samples()] + [None, "", " \n\x0b", "é é é " * 30]
    runs, text = periodic._slice_of(pa.array(every), 12)
    for row, t, whole in zip(runs.to_pylist(), text.to_pylist(), every, strict=True):
        words = [w for w in (whole or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        want = plain_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in row] == want and t == collapsed(words, want)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(every)] + [(None, "a " * 20, None, None)] * 2, "doc_id long, text string, runs string, collapsed string")
    out = periodic.periodic_runs(docs).collect()
    assert len(out) == len(every) + 2 and sum(r.doc_id is None and r.collapsed == "a" for r in out) == 2
    assert periodic.periodic_runs(docs.filter("false")).count() == 0


def plain_row(doc_id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(words, runs)))


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"](spark, str(DATA))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [r for r in docs if len((r.text or "").split()) <= 3000]
    by = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(by) == len(docs) and len(short) > 0.9 * len(docs)
    assert all(by[r.doc_id] == plain_row(r.doc_id, r.text) for r in short)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
