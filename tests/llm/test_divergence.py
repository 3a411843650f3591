"""The source audit against its definition."""

import random
import re
from collections import Counter

import pytest

from tickframe.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(lang or "", source or "", TERM.findall(lower(t or ""))) for _, t, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, words in own for w in set(words))
        kept = [w for w, n in df.items() if n >= least]
        counts = {s: Counter() for _, s, _ in own}
        for _, s, words in own:
            counts[s].update(w for w in words if w in set(kept))

        def share(count):
            n = sum(count.values())
            return {w: 1 + 1_000_000_000 * (count[w] + 5) // (n + 5 * len(kept)) for w in kept}

        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in counts if t != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ordered) if part == "pair" or i < top]
    return sorted(out)


def fixture():
    rng = random.Random(3)
    words = ["the", "The", "cat", "straße", "É", "é", "ß", "日本", "don't", "x1y", "a-b", "zz zz", "can", "cans", "an"]
    rows = []
    for i in range(220):
        lang, source = rng.choice(["en", "de", None, "fr"]), rng.choice(["a", "b", "é", None, "B", "hot", "hot"])
        rows.append((i, rng.choice([" ", "\n", "  ", ","]).join(rng.choice(words[: rng.randint(3, 15)]) for _ in range(rng.randint(0, 40))), lang, source, "t", 1))
    rows += [(300, None, "en", "none", None, None), (301, "", "xx", "alone", None, None), (302, "", "yy", "b", None, None), (303, "rare words", "yy", "a", None, None)]
    return rows + [rows[0]] * 3 + [(304, "the cat " * 3000, "en", "hot", None, None), (None, "the", None, None, None, None)]


@pytest.mark.parametrize("part_bytes", [1 << 20, 12])
def test_audit(spark, part_bytes):
    """Also with a vocabulary in several parts."""
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.audit(docs, least_docs=6, top=4, part_bytes=part_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 6, 4)


def test_parts_are_bounded_and_empty_tables(spark):
    docs = spark.createDataFrame(fixture(), SCHEMA)
    kept = divergence.document_frequencies(docs).select("lang", "term")
    parts, n = divergence.parted(kept, 20)
    sizes = Counter()
    for r in parts.collect():
        sizes[r.part] += len(r.term.encode()) + 1
    assert n > 1 and max(sizes) < n and sum(sizes.values()) > 20 and max(sizes.values()) <= 40
    assert divergence.audit(docs.filter("false")).count() == 0
    assert sorted(tuple(r) for r in divergence.audit(docs, least_docs=10**6).collect()) == plain(fixture(), 10**6, 50)


def test_matches_are_whole_terms():
    automata = divergence.Automata([("en", "can"), ("en", "an"), ("en", "a")])
    assert automata.count("en", " can can a an cans  can ") == Counter({0: 3, 2: 1, 1: 1}) and not automata.count("de", " can ")
