"""The pipeline's near-duplicates in a large family of texts that are almost alike."""

import random

import numpy as np

from tickframe.llm import simhash


def family(n: int):
    """Texts of one template that are hardly alike enough, and a close copy of every third."""
    rng, rows = random.Random(21), []
    template = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
    for i in range(n):
        words = list(template)
        for at in rng.sample(range(len(words)), 5):
            words[at] = f"x{rng.randint(0, 30000)}"
        rows.append((2 * i, " ".join(words)))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = f"y{rng.randint(0, 30000)}"
            rows.append((2 * i + 1, " ".join(words)))
    return rows


def least_of_components(rows):
    """The least id of each component of links of 0.8 or more, by all pairs."""
    place: dict = {}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    own = [[place.setdefault(x, len(place)) for x in s] for s in sets]
    has = np.zeros((len(rows), len(place)), np.float32)
    for i, x in enumerate(own):
        has[i, x] = 1
    both, n = has @ has.T, has.sum(axis=1)
    alike, root = both / (n[:, None] + n - both) >= 0.8, np.arange(len(rows))
    while (lower := np.where(alike, root, len(rows)).min(axis=1)).tolist() != root.tolist():
        root = lower
    return {rows[i][0] for i in root}


def test_pairs_of_a_large_family_are_not_rows(spark, monkeypatch):
    """No link is lost, and the pairs whose texts are met by rows don't grow with the square of the family."""
    similar, seen = simhash.similar, []
    monkeypatch.setattr(simhash, "similar", lambda found, *more: seen.append(found.count()) or similar(found, *more))
    for n in (150, 300):
        seen.clear()
        rows = family(n)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.doc_id for r in simhash.deduplicate(docs, words=3).collect()} == least_of_components(rows)
        assert len(least_of_components(rows)) > 0.9 * n and sum(seen) <= simhash.CROWD * len(rows) / 8


def test_similarity_between_hundredths(spark):
    rows = [(i, t) for i, (_, t) in enumerate(family(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.deduplicate(docs, words=2, least=0.425).count() == 1
