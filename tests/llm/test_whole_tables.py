"""Queries and the pipeline over the smallest tables, against plain versions."""

import hashlib
import unicodedata
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickframe.llm import langid, media, packing
from tickframe.llm.common import written
from tickframe.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def table(sql):
    con = duckdb.connect()
    found = con.execute(sql.replace("@", f"'{DATA}/").replace("!", ".parquet'"))
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


def result(spark, name):
    return QUERIES[name](spark, str(DATA)).collect()


class Article(HTMLParser):
    """Text of the article elements by Python's own parser; a block ends at every paragraph or heading."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append([])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def test_pages(spark):
    want = {}
    for r in table("SELECT page_id, url, html FROM @pages!"):
        reader = Article()
        reader.feed(r["html"] or "")
        reader.close()
        want[r["page_id"], r["url"]] = "\n".join(x for b in reader.blocks if (x := " ".join("".join(b).split())))
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in result(spark, "op1_html_extract")}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_conversations(spark):
    turns = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in table("SELECT conv_id, role, text FROM @conversations! ORDER BY conv_id, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"):
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = {r.conv_id: r for r in result(spark, "op2_chat_format")}
    assert got.keys() == turns.keys()
    for k, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a}\n{b}\n" for a, b in own), loss)]
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(own), digests[0], len(loss), digests[1])
        assert got[k].formatted_chars >= sum(len(t) for _, t in own)


def test_media(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table("SELECT doc_id, text FROM @documents!")}
    by_text = {}
    for r in result(spark, "op4_media_png"):
        data = docs[r.doc_id]
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        image = media.write_png(np.frombuffer(padded, np.uint8).reshape(-1, 64))
        assert (r.media_bytes, r.media_sha256, r.error) == (len(image), hashlib.sha256(image).hexdigest(), None)
        assert by_text.setdefault(data, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_packing(spark):
    lengths = {r["doc_id"]: r["n"] for r in table(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n FROM @documents!")}
    out = result(spark, "op6_best_fit_pack")
    total, bins = Counter(), {}
    for r in out:
        total[r.doc_id] += r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert total == lengths
    for own in bins.values():
        assert own[0].capacity == min(c for c in packing.CAPACITIES if c >= sum(r.n_tokens for r in own))
    assert sum(own[0].capacity for own in bins.values()) <= 1.02 * sum(lengths.values()) + packing.CAPACITIES[-1]


def test_sharding(spark):
    docs = {r["doc_id"]: r["text"] for r in table("SELECT doc_id, text FROM @documents!")}
    out = result(spark, "op9_shard")
    shard_of, slots, loads = {}, {}, Counter()
    for r in out:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(docs[r.doc_id], r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    assert len(out) == len(docs) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(loads.values()) - min(loads[k] for k in range(16)) <= max(max(len((t or "").encode()) for t in docs.values()), 0.02 * sum(loads.values()))


def plain_distance(text, profile, size=langid.PROFILE):
    """Out-of-place distance by dictionaries."""
    words = "_".join(["", *"".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split(), ""]) or "_"
    grams = Counter(words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1) if words[i : i + n] != "_" and not (n == 3 and words[i + 1] == "_"))
    return grams, profile, size


def test_language(spark):
    docs = {r["doc_id"]: r for r in table("SELECT doc_id, text, lang FROM @documents!")}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts: dict = {}

    def code(g):
        c = [ord(x) for x in g]
        return (c[0], c[0] << 21 | c[-1] | 1 << 62, (c[0] << 42 | c[len(c) // 2] << 21 | c[-1]) - (1 << 63))[len(g) - 1]

    def own_grams(text):
        return plain_distance(text, None)[0]

    for i, r in docs.items():
        if not held(i) and r["lang"] and r["text"] is not None:
            counts.setdefault(r["lang"], Counter()).update(own_grams(r["text"]))
    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))][: langid.PROFILE]
    profiles = {k: {g: i for i, g in enumerate(ranked(c))} for k, c in counts.items()}
    right = 0
    for r in result(spark, "op10_language_id"):
        text, own = docs[r.doc_id]["text"], ranked(own_grams(docs[r.doc_id]["text"] or ""))
        assert r.held_out == held(r.doc_id)
        if text is None or not own:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        d = {k: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(d), key=lambda k: d[k])
        assert r.lang_pred == best and r.score == pytest.approx(1 - d[best] / (langid.PROFILE * len(own)))
        right += r.lang_pred == docs[r.doc_id]["lang"]
    assert right >= 0.97 * sum(r["lang"] is not None for r in docs.values())


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_pipeline(spark, monkeypatch):
    """A whole run: each stage on what the stage before kept, against a plain version."""
    seen = []

    def noted(stage):
        def run(spark, docs, sf_dir):
            seen.append((docs.columns, docs.collect()))
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, noted(stage)) for name, stage in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(DATA)).collect()
    assert all(columns == seen[0][0] for columns, _ in seen)
    docs, ruled, spoken, single, mixed = (rows for _, rows in seen)
    kept = {r.doc_id for r in QUERIES["op5_quality_rules"](spark, str(DATA)).filter("kept").collect()}
    assert {r.doc_id for r in ruled} == kept and len(spoken) >= 0.99 * len(kept)
    sets = {r.doc_id: shingles(r.text) for r in spoken}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    left = {r.doc_id for r in single}
    assert set(root.values()) <= left and len(left - set(root.values())) <= 2
    before, after = Counter(), Counter()
    for rows, sums in ((single, before), (mixed, after)):
        for r in rows:
            sums[r.source] += len((r.text or "").split())
    assert all(after[s] <= 2 * before[s] for s in after) and abs(sum(after.values()) - 1.5 * sum(before.values())) <= 0.05 * sum(before.values())
    assert sum(r.n_tokens for r in out) == sum(len((r.text or "").split()) + 1 for r in mixed)


def test_pipeline_cases(spark, tmp_path):
    """An empty table, and columns named like the operators' own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
    names = ("k", "fp", "size", "h", "node", "set", "g", "piece", "n", "low", "times")
    more = written(docs.withColumns({k: F.lit(i) for i, k in enumerate(names)}), "clashing")
    for _, stage in corpus_pipeline.STAGES[:4]:
        more = written(stage(spark, more, str(DATA)), "clashing")
        assert more.columns == [*docs.columns, *names]
    assert corpus_pipeline.STAGES[4][1](spark, more, str(DATA)).count() > 0
