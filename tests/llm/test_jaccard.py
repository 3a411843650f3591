"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from tickframe.llm import jaccard

SCHEMA = "doc_id long, text string, set string, h int, root int"


def plain(rows, size=5, percent=80):
    """doc_id -> (number of shingles, least id of the component), by all pairs."""
    sets = []
    for i, t, *_ in rows:
        words = (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ", "")).split(" ")
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words if w]
        sets.append({" ".join(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))} if words else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, *_), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(s), least.get(r)) for (i, *_), s, r in zip(rows, sets, root)), key=str)


def family(rng, n, length, changes, vocabulary):
    base = [rng.choice(vocabulary) for _ in range(length)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(*changes)):
            words[rng.randrange(length)] = rng.choice(vocabulary)
        yield " ".join(words)


def fixture():
    """Families that link and families around the threshold, a passage that many share, copies, and the defined cases."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = [*family(rng, 40, 120, (0, 3), vocabulary), *family(rng, 30, 120, (1, 8), vocabulary), *family(rng, 12, 30, (0, 2), vocabulary)]
    texts += [f"{' '.join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))} {passage}" for _ in range(40)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50))) for _ in range(20)]
    texts += texts[:25] + [texts[3].upper(), "a b", "A\tb", "a b", "x", None, "", " \n", None]
    rows = [(i, t, "s", 1, 2) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None), (None, "only here", None, None, None), (7, texts[7], "s", 1, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bounds", [{}, {"block": 4, "bucket": 256, "step": 4, "hot": 16, "fragments": 3}])
def test_all_pairs(spark, bounds):
    """Also with families of many blocks, shingles dealt in two steps, and hot shingles."""
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = jaccard.join_documents(docs, **bounds)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert len({c for _, _, c in plain(rows)}) < len(rows) - 60


def test_other_sizes_and_no_rows(spark):
    rows = fixture()[::2]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = jaccard.join_documents(docs, size=2, percent=55, block=8)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 2, 55)
    assert jaccard.join_documents(docs.filter("false")).count() == 0


def test_hot_shingles_stay_bounded(spark):
    docs = spark.createDataFrame(fixture(), SCHEMA).coalesce(1)
    sets = jaccard.with_sets(docs)
    every, few = jaccard.hot_shingles(sets, 16), jaccard.hot_shingles(sets, 16, most=40)
    assert 40 < len(every) and len(few) <= 40 and set(few) <= set(every)


def test_prefix_is_enough():
    """Two sets that link share a shingle of both prefixes, whatever the order."""
    rng = np.random.default_rng(1)
    for _ in range(500):
        n = int(rng.integers(1, 60))
        x = rng.permutation(1000)[:n]
        y = np.concatenate([x[rng.random(n) < rng.uniform(0.7, 1)], 1000 + np.arange(rng.integers(0, 8))])
        if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            cut = [set(np.sort(s)[: int(jaccard.prefix_length(np.array(len(s))))]) for s in (x, y)]
            assert cut[0] & cut[1]


def test_packed_hashes_come_back():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000, 100_000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (jaccard._hashes(jaccard._gaps(h), len(h)) == h).all() and len(jaccard._gaps(h)) in (8 + 6 * (len(h) - 1), 8 * len(h))
