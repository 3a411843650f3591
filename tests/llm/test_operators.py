"""The operators against brute-force versions, round trips, and the defined cases."""

import hashlib
import math
import os
import random
import struct
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tickframe.llm import chat, html, katz, langid, media, mixing, packing, quality, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)


def odd_docs(spark):
    """Nulls in every column, empty, long and repeated texts."""
    long = " ".join(texts(100, 5))
    return docs_of(spark, [(None, None, None), (1, "", "a"), (2, long, None), (3, long, "b"), (3, long, "b"), (4, "\x1c x \x0b y", "a"), (5, "ß  É\n\nß", None)]).withColumns({"fp": F.lit(1), "k": F.lit("x"), "size": F.lit(2), "g": F.lit(3)})


def test_quality(spark):
    rows = [(i, t, None) for i, t in enumerate(texts())] + [(90, "a b c a b c a b c x\nq\nq\n\n# $", None), (91, None, None)]
    got = {r.doc_id: r for r in quality.ledger(docs_of(spark, rows)).collect()}
    for i, t, _ in rows:
        words = (t or "").split()
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + o for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(words), len(repeated), len(lines) - len(set(lines)))
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")


def test_quality_filter_and_ablation(spark):
    docs = odd_docs(spark)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 3]
    by = {r.rule: r for r in quality.ablation(quality.ledger(docs), quality.POLICIES["v1"]).collect()}
    assert by["few_words"].n_failed == 4 and by["few_words"].n_kept_without == 5  # documents 4 and 5 have short words too


def test_quality_filtered_query(spark, tmp_path):
    """A filter on the query's result reads the stored ledger: no measure is evaluated in it."""
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = quality.query(spark, f"file://{tmp_path}")
    for condition, ids in (("kept", [2, 3, 3]), ("not base_failed", [2, 3, 3]), ("fail_bits & 1 = 1", [None, 1, 4, 5])):
        found = out.filter(condition)
        assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
        assert sorted((r.doc_id for r in found.collect()), key=lambda i: (i is not None, i)) == ids


def test_language_of_no_letters():
    """By categories: what has no letter teaches and predicts nothing."""
    known = langid.Profiles({"en": langid.top(*langid.grams("the cat sat on the mat")), "de": langid.top(*langid.grams("die katze sitzt auf der matte"))})
    for text in ("", "²", "½ ①", "12 34", "٣ ४", "-_-", "Ⅷ ", "\u0301"):
        assert not any(unicodedata.category(c).startswith("L") for c in text) and known.predict(text) == ("und", 0.0)
    for text in ("é", "x²", "日本"):
        assert known.predict(text)[0] in ("de", "en")


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 9), rng.choice(["a", "b", "c", None, "é"])) for i in range(400)]
    sized, plan = mixing.mix_plan(docs_of(spark, rows))
    out = mixing.taken(sized, plan).collect()
    size = Counter()
    for r in out:
        size[r.source] += r.size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    budget = 1.5 * sum(size.values())
    while True:  # cap and reshare until none is above
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            break
        target |= {s: 2 * size[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    for s in order:
        own = [r for r in out if r.source == s]
        assert own[0].target == pytest.approx(target[s])
        assert abs(sum(r.size * min(2, r.times) for r in own) - target[s]) <= 9


def test_mixing_cases(spark):
    docs = odd_docs(spark)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(docs.filter("false")).count() == 0
    assert mixing.mix_documents(docs_of(spark, [(1, None, "a"), (2, "", "b")])).count() == 0


def test_tree_and_best_fit():
    rng = random.Random(4)
    tree, own = sharding.BalancedTree(), set()
    for _ in range(3000):
        x = (rng.randint(0, 200), rng.randint(0, 3))
        if x in own:
            tree.remove(x)
            own.remove(x)
        else:
            tree.insert(x)
            own.add(x)
        bound = (rng.randint(0, 200), -1)
        assert tree.at_least(bound) == min((k for k in own if k >= bound), default=None)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    bins: list[int] = []
    want = [0] * 200
    for i in sorted(range(200), key=lambda i: -sizes[i]):
        fits = [(room, b) for b, room in enumerate(bins) if room >= sizes[i]]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(100)
        bins[b] -= sizes[i]
        want[i] = b
    assert sharding.best_fit_decreasing(sizes, 100) == want


def test_sharding(spark):
    rows = [(i, t, None) for i, t in enumerate(texts(300))] + [(1000 + i, "same text", None) for i in range(50)] + [(2000, None, None)]
    out = sharding.shard_documents(docs_of(spark, rows), 4, 64).collect()
    assert len(out) == len(rows) and len({r.shard for r in out if r.grp == hashlib.md5(b"same text").hexdigest()}) == 1
    for k in range(4):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    loads = [sum(r.size for r in out if r.shard == k) for k in range(4)]
    assert max(loads) - min(loads) < 0.05 * sum(loads)
    assert sharding.shard_documents(docs_of(spark, rows).filter("false")).count() == 0


def test_packing(spark):
    rows = [(i, "w " * random.Random(i).randint(0, 700), None) for i in range(120)] + [(500, None, None), (501, "w " * 5000, None), (501, "w " * 5000, None)]
    out = packing.pack_documents(docs_of(spark, rows), group_rows=50).collect()
    assert sum(r.n_tokens for r in out) == sum(len((t or "").split()) + 1 for _, t, _ in rows)
    bins: dict = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.position)
        used = 0
        for k, r in enumerate(own):
            assert (r.position, r.offset) == (k, used)
            used += r.n_tokens
        assert own[0].capacity == min(c for c in packing.CAPACITIES if c >= used)
    assert packing.pack_documents(docs_of(spark, rows).filter("false")).count() == 0


def plain_pack(sizes, capacities, bin_cost):
    """The packing by its definition, on a list."""
    left, bins = sorted(((x, -i) for i, x in enumerate(sizes)), reverse=True), []
    while left:
        best = None
        for c in sorted(capacities):
            if c < left[0][0]:
                continue
            taken, room, rest = [left[0]], c - left[0][0], left[1:]
            for item in rest:
                if item[0] <= room:
                    taken.append(item)
                    room -= item[0]
            held = sum(x for x, _ in taken)
            fitted = min(k for k in capacities if k >= held)
            if best is None or (fitted + bin_cost) / held < best[0]:
                best = ((fitted + bin_cost) / held, fitted, taken)
        bins.append((best[1], [-i for _, i in best[2]]))
        left = [item for item in left if item not in best[2]]
    return bins


def cheapest(sizes, capacities, bin_cost):
    """The least cost of all partitions."""
    def best(rest, bins):
        if not rest:
            return sum(min(c for c in capacities if c >= b) + bin_cost for b in bins)
        out = best(rest[1:], [*bins, rest[0]])
        for k in range(len(bins)):
            if bins[k] + rest[0] <= max(capacities):
                out = min(out, best(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]]))
        return out

    return best(sizes, [])


def test_pack_against_plain():
    rng = random.Random(8)
    for trial in range(60):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))]
        capacities, cost = ((8, 16, 64), 2) if trial % 2 else ((64, 100), 0)
        assert sorted((c, sorted(m)) for c, m in packing.pack(sizes, capacities, cost)) == sorted((c, sorted(m)) for c, m in plain_pack(sizes, capacities, cost))
    ratios = []
    for _ in range(40):
        sizes = [rng.randint(1, 64) for _ in range(7)]
        made = sum(c + 2 for c, _ in packing.pack(sizes, (16, 32, 64), 2))
        ratios.append(made / cheapest(sizes, (16, 32, 64), 2))
    assert min(ratios) >= 1 and sum(ratios) / len(ratios) < 1.06 and max(ratios) < 1.3


def test_png():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (3, 64), (40, 64), (7, 5)):
        a = rng.integers(0, 256, shape, np.uint8)
        image = media.write_png(a)
        assert (media.read_png(image) == a).all()
        for at in (0, 20, len(image) // 2, len(image) - 5):
            broken = bytearray(image)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                media.read_png(bytes(broken))
    raw = rng.integers(0, 256, (5, 9), np.uint8)
    rows = np.zeros((5, 10), np.uint8)
    rows[:, 0] = range(5)
    for y in range(5):
        for x in range(9):
            left, up = int(raw[y, x - 1]) if x else 0, int(raw[y - 1, x]) if y else 0
            corner = int(raw[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(p - v))
            rows[y, x + 1] = (int(raw[y, x]) - (0, left, up, (left + up) // 2, paeth)[y]) % 256
    assert (media._unfilter(rows) == raw).all()


def test_png_broken_headers():
    good = media.write_png(np.zeros((2, 3), np.uint8))
    chunk = media._chunk
    header = lambda *x: chunk(b"IHDR", struct.pack(">IIBBBBB", *x))
    rest = good[33:]
    for bad in (
        chunk(b"IHDR", b"short") + rest, chunk(b"IHDR", bytes(20)) + rest, header(1 << 31, 1 << 31, 8, 0, 0, 0, 0) + rest, header(0, 1, 8, 0, 0, 0, 0) + rest,
        header(3, 2, 16, 0, 0, 0, 0) + rest, header(3, 2, 8, 0, 0, 0, 0) + header(3, 2, 8, 0, 0, 0, 0) + rest, header(3, 2, 8, 0, 0, 0, 0) + chunk(b"IEND", b""),
        header(3, 2, 8, 0, 0, 0, 0) + chunk(b"IDAT", b"no zlib") + chunk(b"IEND", b""), header(3, 9, 8, 0, 0, 0, 0) + rest, b"",
    ):
        with pytest.raises(ValueError):
            media.read_png(media.SIGNATURE + bad)


def test_cosine_hash():
    """Against the transform by its formula, on images whose squeeze is exact."""
    rng = np.random.default_rng(3)
    for height, width in ((32, 64), (64, 64), (96, 32)):
        a = rng.integers(0, 256, (height, width), np.uint8)
        small = a.reshape(32, height // 32, 32, width // 32).astype(float).mean(axis=(1, 3))
        low = []
        for u in range(8):
            for v in range(8):
                total = sum(small[y, x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32))
                low.append(round(total / 16 * (1 if u else 0.5**0.5) * (1 if v else 0.5**0.5), 6))
        middle = sorted(low[1:])[31]
        assert media.cosine_hash(a) == bytes(sum((low[8 * i + k] > middle) << (7 - k) for k in range(8)) for i in range(8))


def test_media_query_shape(spark):
    out = media.read_images(media.text_images(odd_docs(spark))).collect()
    assert all(r.error is None and len(r.payload) % 64 == 0 and len(r.payload) >= 64 for r in out)
    assert len({r.feature for r in out if r.doc_id in (2, 3)}) == 1
    bad = media.read_images(spark.createDataFrame([(b"x",), (None,)], "image binary")).collect()
    assert all(r.payload is None and r.error for r in bad)
    clash = spark.createDataFrame([(1, b"x", "old", "old")], "doc_id long, data binary, payload string, error string")
    row = media.read_images(media.write_images(clash, "data")).first()
    assert (row.doc_id, row.payload, row.error) == (1, b"x" + bytes(63), None)
    assert media.read_images(media.text_images(odd_docs(spark).filter("false"))).count() == 0


def test_chat_round_trip():
    for t in ("</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "\\<|", "<\\|", "[/INST\\]", "a\\\\n", "", "<<SYS>>", "\\"):
        assert chat.unescape(chat.escape(t)) == t and chat.END not in chat.escape(t) and "[INST]" not in chat.escape(t) and "</s>" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t + "\n" + t)) == t + "\n" + t
    rng = random.Random(3)
    for trial in range(60):
        turns = [(rng.choice(["user", "assistant"]), "w " * rng.randint(0, 40) + rng.choice(["", "</s>", "<|im_end|>"])) for _ in range(rng.randint(1, 12))]
        if trial % 2:
            turns[0] = ("system", "be kind")
        made = list(chat.windows(turns, 60, 25))
        back = [t for w in made for t in chat.parse(w.text)[w.n_kept :]]
        assert back == turns
        masked = "".join(chat.unescape(w.text[a:b]) for w in made for a, b in w.loss)
        assert masked == "".join(t for r, t in turns if r == "assistant")
        for w in made[1:]:
            assert trial % 2 == 0 or w.text.startswith(chat.START + "system")
        assert all(w.n_tokens <= 60 or w.n_new == 1 for w in made[1:])


def test_chat_cases(spark):
    rows = spark.createDataFrame([(None, 1, None, None), (1, None, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(rows)).collect()}
    assert out[None].n_turns == 1 and out[1].n_turns == 3 and out[1].loss_chars == 1
    assert out[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.read_back(chat.format_conversations(rows.filter("false"))).count() == 0


def brute_katz(train, order=2):
    """(log10 P of a text, total probability of a context) by the definition."""
    counts = {k: Counter() for k in range(1, order + 1)}
    for t in train:
        w = [*t.lower().split(), "\n"]
        row = ["^"] * (order - 1) + w
        for i in range(order - 1, len(row)):
            for k in counts:
                counts[k][tuple(row[i - k + 1 : i + 1])] += 1
    words, n = counts[1], sum(counts[1].values())
    d = {k: katz.discounts([len(c)] + [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]) for k, c in counts.items()}
    disc = lambda k, c: d[k][c] if c <= katz.K else 1.0
    left = sum((1 - disc(1, c)) * c for c in words.values()) / n if n else 1.0
    scale, unseen = (1.0, left) if left > 0 else (n / (n + 1), 1 / (n + 1))
    followers = {k: {} for k in counts}
    for k, c in counts.items():
        for g, x in c.items():
            followers[k].setdefault(g[:-1], {})[g[-1]] = x

    def p(h, w):
        if not h:
            c = words[(w,)]
            return disc(1, c) * c / n * scale if c else unseen
        seen = followers[len(h) + 1].get(h)
        if not seen:
            return p(h[1:], w)
        k, total = len(h) + 1, sum(seen.values()) + (not any(c <= katz.K for c in seen.values()))
        if w in seen:
            return disc(k, seen[w]) * seen[w] / total
        if h not in alpha:
            alpha[h] = (1 - sum(disc(k, c) * c for c in seen.values()) / total) / (1 - sum(p(h[1:], x) for x in seen))
        return alpha[h] * p(h[1:], w)

    alpha = {}

    def score(text):
        row = ["^"] * (order - 1) + [*text.lower().split(), "\n"]
        return sum(math.log10(p(tuple(row[i - order + 1 : i]), row[i])) for i in range(order - 1, len(row)))

    return score, lambda h: sum(p(h, x) for x in [w for (w,) in words] + ["unseen!"])


KATZ_ROWS = [(i, t, None) for i, t in enumerate(texts(50, 8))] + [(100, None, None), (101, "QQ zz qq", None), (102, "the the the " * 30, None), (103, "a\x0bb  \n a b c", None), (None, "d e", None), (None, "d e", None)]


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(katz, "LEAST_BUCKETS", 8)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(spark, few_buckets, order):
    rows = KATZ_ROWS
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 2
    got: dict = {}
    for r in katz.score_documents(docs_of(spark, rows), held, order).collect():
        got.setdefault(r.doc_id, []).append(r)
    train = [t or "" for i, t, _ in rows if (i or 0) % 3 != 2]
    words = Counter(w for t in train for w in [*t.lower().split(), "\n"])
    n = sum(words.values())
    score, total = brute_katz(train, order)
    assert sum(map(len, got.values())) == len(rows) and len(got[None]) == 2
    for i, t, _ in rows:
        own = [*(t or "").lower().split(), "\n"]
        for r in got[i]:
            assert r.score == pytest.approx(score(t or ""), rel=1e-9)
            assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + len(words) + 1)) for w in own), rel=1e-9)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(words[w] > 0 for w in own), n)
    for h in ("^", "the", *list(words)[:20]):
        for k in range(1, order):
            assert total(("^",) * (k - 1) + (h,)) == pytest.approx(1.0)
            assert total(("the",) * (k - 1) + (h,)) == pytest.approx(1.0)


def test_katz_cases(spark, few_buckets):
    rows, held = KATZ_ROWS, F.col("doc_id") % 3 == 2
    assert katz.score_documents(docs_of(spark, rows).filter("false"), held).count() == 0
    assert all(r.score == 0 for r in katz.score_documents(docs_of(spark, rows), F.lit(True)).collect())
    named = docs_of(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumn("block", F.lit(1))
    assert sorted(r.doc_id for r in katz.score_documents(named, F.lit(False)).filter("doc_id is not null").collect())[0] == "d0"


def scored(df, order=2):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score_documents(df, F.col("doc_id") % 3 == 2, order).collect())


def test_katz_equal_partitions(spark, few_buckets):
    """Rows that two partitions both have, ids or none, count twice in training and are scored once each."""
    rows = [(i, t, None, None, None) for i, t in enumerate(texts(20, 8))] + [(None, "one two three", None, None, None)]
    twice = spark.createDataFrame(spark.sparkContext.parallelize(rows + rows, 2), SCHEMA)
    assert twice.rdd.getNumPartitions() == 2
    got = scored(twice)
    assert got == scored(twice.coalesce(1)) == scored(docs_of(spark, [(i, t, s) for i, t, _, s, _ in rows]).union(docs_of(spark, [(i, t, s) for i, t, _, s, _ in rows])))
    assert all(r[2] <= r[1] for r in got)


@pytest.mark.parametrize("order", [2, 3])
def test_katz_blocks_and_hot_contexts(spark, monkeypatch, order):
    """Cutting texts, blocks of any size and dealing hot contexts over buckets change nothing."""
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate(texts(40, 8))] + [(50, " ".join(texts(30, 2)) + " the end", None), (51, "x y " * 400, None)])
    want = scored(docs, order)
    score, _ = brute_katz([r.text or "" for r in docs.filter("doc_id % 3 <> 2").collect()], order)
    by = {r[0]: r[5] for r in want}
    assert all(by[str(r.doc_id)] == pytest.approx(score(r.text), abs=1e-5) for r in docs.collect())
    real = katz.hot_contexts
    hots = []
    monkeypatch.setattr(katz, "HOT_SAMPLE", 1)
    monkeypatch.setattr(katz, "hot_contexts", lambda *a: hots.append(real(*a)) or hots[-1])
    assert scored(docs, order) == want and len(hots[0].ids) >= 3 and hots[0].splits.max() > 1


def test_katz_blocks():
    """Blocks hold the texts whole: cut at white space, the words before it carried over."""
    rows = [(i, t, i % 3 == 0) for i, t in enumerate([*texts(30, 4), None, "", "word " * 500, "é" * 300, " lead  and\ntrail "])]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["doc_id", "text", "held"])

    def counted(room, order):
        grams, by_text = Counter(), Counter()
        for block in katz.blocks_of(iter([batch.slice(0, 9), batch.slice(9)]), order, room):
            own, word, ctx, at, tokens = katz.contexts_of(block, order)
            grams.update(zip(*ctx.tolist(), own[word].tolist()))
            for i, n in zip(block.ids.to_pylist(), tokens.tolist()):
                by_text[i] += n
        return grams, by_text

    for order in (2, 3, 4):
        want = counted(1 << 20, order)
        assert want[1] == Counter({i: len((t or "").split()) + 1 for i, t, _ in rows})
        for room in (50, 200, 700, 5000):
            assert counted(room, order) == want
    assert max(sum(len(x or "") for x in b.texts.to_pylist()) for b in katz.blocks_of(iter([batch]), 2, 700)) <= 720


def fingerprint(t):
    w = (t or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    rng = random.Random(6)
    base = texts(40, 9)
    rows = [(i, t, None) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        if len(w) > 60:
            w[rng.randrange(len(w))] = "CHANGED"
        rows += [(100 + i, " ".join(w), None), (200 + i, t.upper(), None)]
    rows += [(None, "", None), (900, None, None), (901, "long " * 3000 + "x" * 300, None), (7, base[7], None)]
    out = simhash.components_of_documents(docs_of(spark, rows)).collect()
    fp = {t: fingerprint(t) for _, t, _ in rows}
    values = sorted(set(fp.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[find(fp[t])] = min(i, least.get(find(fp[t]), i))
    assert len(out) == len(rows)
    text_of = dict((i, t) for i, t, _ in rows)
    for r in out:
        assert r.fp % (1 << 64) == fp[text_of[r.doc_id]] and r.component_id == least[find(fp[text_of[r.doc_id]])]


def test_simhash_dense_groups():
    rng = np.random.default_rng(5)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    fp = np.unique(np.concatenate([[center ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(900)], rng.integers(0, 1 << 63, 500, dtype=np.uint64)]).astype(np.uint64))
    key = simhash.variants(fp).ravel()
    order = np.argsort(key, kind="stable")
    a, b = simhash._group_links(key[order], np.repeat(fp, 64)[order], 4)
    assert (np.bitwise_count(a ^ b) <= 4).all()

    def parts(pairs):
        root = {int(v): int(v) for v in fp}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for x, y in pairs:
            root[max(find(int(x)), find(int(y)))] = min(find(int(x)), find(int(y)))
        return {v: find(v) for v in root}

    every = [(x, y) for i, x in enumerate(fp) for y in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ x) <= 4]]
    assert parts(zip(a, b)) == parts(every)


def test_deduplicate(spark):
    docs = odd_docs(spark)
    out = simhash.deduplicate(docs, words=2)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4, 5]
    assert simhash.deduplicate(docs.filter("false"), words=2).count() == 0


PAGE = '<html><head><title>T</title><script>a("</p>")</script></head><body><nav><a href="/">Home</a></nav><div class="site-header">Top</div><div>Shared note</div>{}<footer>&copy; x</footer></body></html>'


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_deduplicate_against_all_pairs(spark):
    """Only links of a similarity of 0.8 or more unite documents, and close copies are all found."""
    rng, rows = random.Random(11), []
    for i in range(40):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(210, 400))]
        rows.append((10 * i, " ".join(words), None))
        for k, edits in enumerate((1, 3, 8, 20)):
            own = list(words)
            for at in rng.sample(range(len(own)), edits):
                own[at] = f"x{rng.randint(0, 3000)}"
            rows.append((10 * i + k + 1, " ".join(own), None))
    sets = {i: shingles(t) for i, t, _ in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and a // 10 == b // 10}
    root = {i: i for i in sets}
    for (a, b), j in sorted(alike.items()):
        if j >= 0.8:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    kept = {r.doc_id for r in simhash.deduplicate(docs_of(spark, rows)).collect()}
    assert set(root.values()) <= kept  # the least of each true component stays
    close = {b for (_, b), j in alike.items() if j >= 0.95}
    assert len(close) >= 40 and not close & kept


def test_deduplicate_template_family(spark):
    """Texts of one template are not alike enough to be linked, but each has a close copy: no link gets lost in a large group."""
    rng, rows = random.Random(12), []
    template = [f"w{rng.randint(0, 3000)}" for _ in range(220)]
    for i in range(120):
        words = list(template)
        for at in rng.sample(range(len(words)), 4):
            words[at] = f"x{rng.randint(0, 30000)}"
        own = list(words)
        own[rng.randrange(len(own))] = f"y{rng.randint(0, 30000)}"
        rows += [(2 * i, " ".join(words), None), (2 * i + 1, " ".join(own), None)]
    place: dict = {}
    own = [[place.setdefault(x, len(place)) for x in shingles(t)] for _, t, _ in rows]
    has = np.zeros((len(rows), len(place)), np.float32)
    for i, x in enumerate(own):
        has[i, x] = 1
    both, n = has @ has.T, has.sum(axis=1)
    alike = both / (n[:, None] + n - both) >= 0.8
    root = np.arange(len(rows))
    while (lower := np.where(alike, root, len(rows)).min(axis=1)).tolist() != root.tolist():
        root = lower
    least = set(root.tolist())
    kept = {r.doc_id for r in simhash.deduplicate(docs_of(spark, rows)).collect()}
    assert len(least) > 80 and least <= kept and len(kept - least) <= 0.05 * len(least)


def test_deduplicate_repeated_phrase(spark):
    """A phrase repeated inside texts decides all bits of a fingerprint over shingles with repeats, but makes no texts alike."""
    rng = random.Random(13)
    one, two = (" ".join(f"{k}{rng.randint(0, 30000)}" for _ in range(300)) for k in "ab")
    line = " page of the long report" * 90
    rows = [(1, one + line, None), (2, two + line, None), (3, one + " -" * 400, None), (4, two + " -" * 400, None), (5, two + " -" * 500, None)]
    assert sorted(r.doc_id for r in simhash.deduplicate(docs_of(spark, [rows[2], rows[3], rows[4]]), words=2).collect()) == [3, 4]
    assert sorted(r.doc_id for r in simhash.deduplicate(docs_of(spark, rows), words=2).collect()) == [1, 2]


def test_deduplicate_recall_near_the_threshold(spark):
    """Of pairs at a similarity of 0.84, nine in ten are candidates."""
    rng, rows = random.Random(14), []
    for i in range(200):
        words = [f"w{rng.randint(0, 30000)}" for _ in range(300)]
        own = list(words)
        for at in (30, 90, 150, 210, 270):
            own[at] = f"x{rng.randint(0, 30000)}"
        rows += [(2 * i, " ".join(words), None), (2 * i + 1, " ".join(own), None)]
    kept = {r.doc_id for r in simhash.deduplicate(docs_of(spark, rows)).collect()}
    assert {2 * i for i in range(200)} <= kept and len(kept) <= 200 + 20


def main_of(page):
    return html.main_text(html.lines_of(page))


def test_html_lines():
    page = PAGE.format('<article><header><h1>A&amp;B</h1></header><p>One\n <b>two</b><br>three<p>Four&nbsp;five<div class="comments"><p>Nice!</p></div></article><aside>Side</aside>')
    assert main_of(page) == "A&B\nOne two three\nFour five"
    assert html.lines_of(None) == [] and html.lines_of("plain") == [("plain", html.FREE)]
    assert main_of("<p>kept<form>drop</form><p hidden>gone<p>end") == "kept\nend"


def test_html_odd_markup():
    assert main_of("<p data-x=it's>Hello don't go</p><p>More</p>") == "Hello don't go\nMore"
    assert main_of("<p>a</p><3 y") == "a\n<3 y" and main_of("<p>x < y and a<b> bold</b>") == "x < y and a bold" and main_of("<p>t<p cl") == "t"
    for name in ('id="comment-policy"', 'class="notice-of-meeting"', 'class="related-work"'):
        assert main_of(f"<article><p>A<section {name}>inner</section><p>B</article>") == "A\ninner\nB"
    assert main_of('<form><div class="content with-sidebar"><div>x</div><article><p>Body text</article></div></form>') == "Body text"
    assert main_of('<div><p>The page has its text here</div><div class="sidebar"><article>Teaser</article></div>') == "The page has its text here"
    assert main_of("<p a='1\" b=2>x<p>y</p>") == "x\ny" and main_of("<!-- a -- ><p>x --> b") == "b" and main_of("a<br/>b<script/>c") == "a b c"


def test_html_time_is_linear():
    for bad in ('<p a="x> ', "<p a='x> ", "<script>", "<!-- ", "<a <", "<div>"):
        began = time.time()
        html.lines_of(bad * 20_000)
        assert time.time() - began < 4


def plain_extract(pages):
    """The differencing by its definition: sort, pair, table of common subsequences."""

    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t

    outlines = {p: html.lines_of(h) for p, _, h in pages}
    order = sorted((*html.place(u), p) for p, u, _ in pages if html.place(u)[0])
    out = {}
    for p, u, _ in pages:
        lines = outlines[p]
        near = []
        if html.place(u)[0]:
            at = [x[2] for x in order].index(p)
            near = [x for x in order[max(at - 1, 0) : at] + order[at + 1 : at + 2] if x[0] == order[at][0]]
            near.sort(key=lambda x: -len(os.path.commonprefix([x[1], order[at][1]])))
        texts = [t for t, _ in lines]
        free = [i for i, (_, z) in enumerate(lines) if z == html.FREE]
        gone = [{i for i in free if texts[i] in {t for t, _ in outlines[x[2]]}} for x in near]  # no line repeats or moves in these pages
        assert all(table(texts, [t for t, _ in outlines[x[2]]])[-1][-1] == len({t for t in texts if t in {y for y, _ in outlines[x[2]]}}) for x in near)
        drop = gone[0] if gone else set()
        if sum(len(texts[i]) for i in drop) > html.COPY * sum(len(texts[i]) for i in free):
            drop &= gone[1] if len(gone) > 1 else set()
        best = max((z for _, z in lines), default=html.FREE)
        out[p] = "\n".join(t for i, (t, z) in enumerate(lines) if z == best and i not in drop)
    return out


def test_html_fixture(spark):
    """Fifty pages, most without marks: the result of differencing and structure together."""
    rng, pages = random.Random(5), []
    for i in range(50):
        host = rng.choice(["a.org", "b.org", "c.org"])
        top = [f"Menu {host} {k}" for k in range(5)]
        body = [f"Text {i} {k} " + "w " * rng.randint(1, 20) for k in range(rng.randint(1, 4))]
        if i % 10 == 3:
            body += [f"A passage of {host}"]
        html_ = "".join(f"<div>{x}</div>" for x in top) + ("<article>" if i % 4 == 0 else "<div>") + "".join(f"<p>{x}" for x in body) + ("</article>" if i % 4 == 0 else "</div>") + f"<div>Foot {host}</div>"
        pages.append((i, f"http://{host}/{rng.randint(1, 9)}/p{i:02d}", html_))
    pages += [(60, "http://d.org/x", pages[1][2]), (61, None, pages[2][2]), (62, "http://a.org/9/z", None), (63, "no url", "<p>x")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == plain_extract(pages)
    assert sum("Menu" in got[i] for i in range(50)) <= 3 and all(f"Text {i} 0" in got[i] for i in range(50))


def test_common_lines():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(html.common_lines(a, b))
        assert len(found) == table[-1][-1]
        at = 0
        for i in found:
            at = b.index(a[i], at) + 1


def test_html_differencing(spark):
    pages = [(1, "http://h/a/1", PAGE.format("<p>First")), (2, "http://h/a/2", PAGE.format("<p>Second")), (3, None, PAGE.format("<p>Alone")), (4, "http://h/zz", None), (5, "http://g/1", PAGE.format("<p>Own")), (5, "http://g/1", PAGE.format("<p>Own"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html.extract(df).collect())
    assert got == [(1, "First"), (2, "Second"), (3, "Shared note\nAlone"), (4, ""), (5, "Shared note\nOwn"), (5, "Shared note\nOwn")]
    assert html.extract(df.filter("false")).count() == 0
    clashing = df.withColumns({"k": F.lit(1), "lines": F.lit(2), "host": F.lit(3)}).withColumn("page_id", F.col("page_id").cast("string"))
    assert sorted((r.page_id, r.text) for r in html.extract(clashing).collect()) == [(str(p), t) for p, t in got]


def test_language(spark):
    rng = random.Random(7)
    letters = {"aa": "abcdef", "bb": "cdefgh", "cc": "uvwxyz"}
    make = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 7))) for _ in range(60))
    rows = [(i, make(k), k, None, None) for i in range(90) for k in letters]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    profiles = langid.fit(df.filter("doc_id % 4 <> 2"))
    out = langid.predict(df, profiles, ("doc_id", "lang")).filter("doc_id % 4 = 2").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out) and all(0 <= r.score <= 1 for r in out)
    assert profiles.predict(None) == ("und", 0.0) and profiles.predict("12 _ 3!") == ("und", 0.0)
    assert langid.Profiles({}).predict("abc") == ("und", 0.0)
    assert langid.fit(df.filter("false")).names == []
    assert langid.filter_documents(odd_docs(spark), profiles).columns == odd_docs(spark).columns
    more = df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars").filter("doc_id < 30").union(docs_of(spark, [(900, "mmm nnn ooo ppp " * 20, None), (901, "7 8", None), (902, None, None)]))
    kept = langid.filter_documents(more, profiles).collect()
    assert {r.doc_id for r in kept} == set(range(30)) and {r.lang for r in kept} == set(letters)
    assert {r.lang for r in langid.filter_documents(more, profiles, wanted=["bb"]).collect()} == {"bb"}


def test_kernels_match_library():
    data = b"".join(bytes([i % 251]) for i in range(4000))
    rng = np.random.default_rng(2)
    starts, lengths = rng.integers(0, 3000, 3000), rng.integers(0, 90, 3000)
    got = simhash.xxh64(data, starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(starts.tolist(), lengths.tolist())]
    assert zlib.crc32(b"x") == zlib.crc32(media.payload(b"x")[:1]) and len(media.payload(None)) == 64 and isinstance(pa.array([1]), pa.Array)
