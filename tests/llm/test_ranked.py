"""Importance resampling and the bit-sliced search against brute force, with nulls, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagesift.llm import impact_index, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EXTRA = ["row", "place", "score", "n", "term", "block", "rank", "item", "bucket", "weight"]
DOCS = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
ITEMS = "item_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(n=300, seed=3):
    draw = random.Random(seed)
    vocabulary = ["the", "Of", "Ärger", "naïve", "x1", "42", *[f"w{i}" for i in range(60)]]
    texts = [" ".join(draw.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=draw.randint(0, 60))) for _ in range(n)]
    texts[3:9] = [None, "", "...", texts[0], texts[0], "ÄRGER-the" * 4000]
    return [(i, t) for i, t in enumerate(texts)] + [(5, "the w1 w2 " * 30)] * 3 + [(None, "the w3 of " * 12), (None, "w3 w4 " * 15), (-4, "w5 the " * 20)]


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], schema)


def features(text):
    w = cut(text)
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resampling_equals_brute_force(spark, percent):
    docs, target = corpus(), [(i, t) for i, t in corpus(20, 9)]
    seen, want = Counter(), Counter()
    for _, t in docs:
        seen.update(features(t)[1])
    for _, t in target:
        want.update(features(t)[1])
    s, t = sum(seen.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((seen[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    k = len(able) * percent // 100
    expected = Counter((*(r[0], r[2], r[3], r[4]), at + 1 if at < k else None) for at, r in enumerate(able))
    expected.update((r[0], r[2], r[3], r[4], None) for r in rows if r[1] < 20)
    got = importance.resample(frame(spark, docs, DOCS).repartition(5), frame(spark, target, ITEMS), percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == expected


def test_resampling_of_ties_and_empty_tables(spark):
    empty = frame(spark, [], DOCS)
    same = frame(spark, [(1, "a " * 20)] * 40 + [(2, None)], DOCS)
    assert importance.resample(empty, same).collect() == []
    got = importance.resample(same, empty).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len(got) == 41


@pytest.mark.parametrize("ids", [range(-9, 400, 7), [-(1 << 63), (1 << 63) - 1, 0, 5, -5], [7] * 9, range(1 << 40, (1 << 40) + 300)])
def test_first_k_is_exact_at_every_k(spark, ids):
    draw = random.Random(1)
    rows = [(draw.randint(-5000, 5000) if len(ids) > 9 else 3, i) for i in ids]
    df = spark.createDataFrame(rows, "score long, place long").coalesce(1).cache()
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in {0, 1, 2, len(rows) // 2, len(rows) - 1, len(rows)}:
        got = sorted(map(tuple, df.where(importance.first_k(df, k)).collect()))
        assert got == sorted(r for r in rows if k and (-r[0], r[1]) <= (-ordered[k - 1][0], ordered[k - 1][1]))


def test_grams_of_any_length_continue_the_checksum():
    w = [b"a", b"bc", b"d", b"e"]
    want = [zlib.crc32(b" ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(5 - n)]
    assert importance.features(w, 3, importance.PieceCache(zlib.crc32)) == want


def ranked(docs, items, k):
    docs = [(i, cut(t)) for i, t in docs]
    docs = [(i, Counter(w), len(w)) for i, w in docs if w]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(cut(text))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, size in docs:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, at + 1, None if null else i, -score) for at, (score, null, i) in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 64, "part_pairs": 40}])
def test_search_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(impact_index, "BLOCK_POSTINGS", 500)
    docs, items = corpus(), [(i, t) for i, t in corpus(25, 5)] + [(77, "nowhere else")]
    got = impact_index.rank(frame(spark, docs, DOCS).repartition(3), frame(spark, items, ITEMS), **blocks)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked(docs, items, 50)


def test_search_of_empty_tables(spark):
    empty, some = frame(spark, [], DOCS), frame(spark, [(1, "a b")], DOCS)
    assert impact_index.rank(empty, frame(spark, [(1, "a")], ITEMS)).collect() == []
    assert impact_index.rank(some, frame(spark, [], ITEMS)).collect() == []
    assert impact_index.rank(some, frame(spark, [(1, None), (2, "zzz")], ITEMS)).collect() == []


def test_slices_add_and_rank_as_numbers_do():
    draw = np.random.default_rng(5)
    for _ in range(30):
        n = int(draw.integers(1, 300))
        rows = []
        for _ in range(int(draw.integers(1, 9))):
            values = draw.integers(0, 1 << int(draw.integers(1, 36)), n) * (draw.random(n) < 0.4)
            rows.append(values if values.any() else values + 1)
        n_words, slices = (n + 63) // 64, []
        for values in rows:
            full = np.zeros(n_words * 64, np.int64)
            full[:n] = values
            planes = np.array([np.packbits(((full >> p) & 1).astype(np.uint8), bitorder="little").view(np.uint64) for p in range(int(full.max()).bit_length())])
            at = np.flatnonzero(planes.any(0)).astype(np.uint32)
            slices.append((at, planes[:, at]))
        at, value = impact_index.top_slices(impact_index.add_slices(slices, n_words), 10)
        total = np.sum(rows, axis=0)
        want = sorted((-int(v), i) for i, v in enumerate(total) if v)[:10]
        assert [(-int(v), int(i)) for i, v in zip(at, value)] == want
