"""The corpus operators against brute force, libraries and defined cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import ann, bpe_tree, exact_dedup, html_wrapper, langid, line_dedup, mixing, simhash, token_count, warc
from pagesift.llm.common import connected_components

public = pytest.importorskip("public_tokenizers")
JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, fp string"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "src0", "clash") for i, t in enumerate(texts)], DOCS)


ODD = ["", None, " ", "a", "a  b\tc", "a b c", "<|endoftext|> x<|endoftext|>", "é" * 700, "ab" * 4000, "日本語 🙂👩‍👩‍👧 x", "  \n\n  a", "a b c"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 10), (8, 20), (5, 5)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {2: 1, 3: 1, 10: 1, 9: 8, 20: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", [{}, {"block_bytes": 3, "hashed": lambda c: F.xxhash64(c) % 5}])
def test_exact_dedup(spark, how):
    texts = [*ODD, "x" * 20000, "x" * 20000, "x" * 19999 + "y"]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, texts), **({**how, "block_bytes": 700} if how else how)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (norm.index(t), norm.count(t), norm.index(t) == i)


def test_exact_dedup_repeated_and_empty(spark):
    rows = docs(spark, ["a", "b"]).union(docs(spark, ["a"]))
    got = sorted((r["doc_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows).collect())
    assert got == [(0, 2, False), (0, 2, True), (1, 1, True)]
    assert exact_dedup.exact_dedup(docs(spark, ["a"]).limit(0)).count() == 0


def test_simhash_against_brute_force(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    for _ in range(25):
        base = random.choices(words, k=150)
        for k in range(4):
            some = list(base)
            some[random.randrange(150)] = f"new{k}"
            texts.append(" ".join(some))
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs(spark, texts), chunk=8).collect()}
    fps = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    root[j] = min(root[j], root[i])
    for i, f in enumerate(fps):
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == root[i]


def test_bit_sliced_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = np.concatenate([a ^ (np.uint64(1) << np.uint64(k)) for k in range(6)])
    x, y = simhash.close_pairs(a, b, 4)
    want = np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)
    assert sorted(zip(x, y, strict=True)) == sorted(map(tuple, want))
    assert (simhash.close_lanes(a ^ a[::-1], 4) == (np.bitwise_count(a ^ a[::-1]) <= 4)).all()


def test_token_counts_and_tree_bpe(spark):
    import tiktoken
    from tokenizers import Tokenizer

    random.seed(2)
    texts = ODD + ["".join(random.choice(["th", "an", " ", "é", "'s", "\n", "12"]) for _ in range(200)) for _ in range(60)]
    plain = [t or "" for t in texts]
    tok = Tokenizer.from_file(JSON)
    got = {r["doc_id"]: r for r in token_count.token_counts(docs(spark, texts), JSON, public.PATTERN, limit=5).collect()}
    for i, t in enumerate(plain):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 5)
    codec = bpe_tree.TreeCodec(RANKS, public.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    ids = {r["doc_id"]: r["ids"] for r in bpe_tree.encode_documents(docs(spark, texts), RANKS, public.PATTERN).collect()}
    for i, t in enumerate(plain):
        assert ids[i] == enc.encode_ordinary(t)
        assert codec.decode(codec.encode(t), width=3) == t.encode()


def test_language(spark):
    random.seed(3)
    syllables = {"en": ["the", "ing", "er"], "fr": ["eau", "ê", "ou"], "de": ["sch", "ung", "ü"]}
    rows = [(i, " ".join("".join(random.choices(syllables[g], k=3)) for _ in range(30)), g) for i, g in enumerate(random.choices(list(syllables), k=300))]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "the ing", None), (1003, "", "fr")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train=90).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i]["lang_pred"] == g for i, _, g in rows[:300] if got[i]["held_out"]]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1003)] == ["und"] * 3 and got[1002]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(none).first()["lang_pred"] == "und"


def test_warc(spark):
    pages = [(1, "http://a/x y", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "é" * 500000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.read_bundles(warc.write_bundles(df, frame_bytes=64)).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None)}
    for i, _, h in pages:
        assert got[i]["payload_bytes"] == len((h or "").encode()) and got[i]["payload_digest"] == warc.payload_digest((h or "").encode())
    assert bytes(got[5]["payload"]).decode() == pages[4][2] and got[1]["url"] == "http://a/x%20y"
    assert warc.archive_digest(df.limit(0)).count() == 0


def test_html(spark):
    def src(body, k):
        return f'<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class="ad-slot">buy</div><div><h2>Same on all pages</h2></div><div class="story"><p>Text  number &eacute;{k}<br>more<p>Second {body}</div><div id="comments"><p>rant</p></div><footer>f</footer>'

    pages = [(k, "http://h.example/p", src("x" * k, k)) for k in range(12)] + [(50, None, None), (51, "http://h.example/q", ""), (52, "http://o.example", "<article><h1>H</h1><script>'</p>'</script><p>a<b>b</b> c</article><p>out</p>")]
    got = {r["page_id"]: r for r in html_wrapper.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Text number é3 more\nSecond xxx" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[50]["text"] == "" and got[51]["text"] == "" and got[52]["text"] == "H\nab c"


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[100] = x[40]
    rows = [(i, [float(np.float32(v)) for v in r], "e") for i, r in enumerate(x)]
    rows += [(1000, None, "e"), (1001, [0.0] * 16, "e"), (1002, [float("nan")] * 16, "e"), (1003, [None] * 16, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = ann.search(df, list_rows=60).toPandas()
    v = np.array([r[1] for r in rows[:600]])
    hit = 0
    for q in range(0, 600, 20):
        s = v @ v[q]
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and mine.score.is_monotonic_decreasing and math.isclose(mine.score.iloc[0], float(v[q] @ v[mine.vec_id.iloc[0]]), rel_tol=1e-12)
        hit += len(set(np.argsort(-s, kind="stable")[:20]) & set(mine.vec_id))
    assert hit / 600 >= 0.9
    assert ann.search(df.limit(0)).count() == 0


def test_lines(spark):
    base = " ".join(f"word{i}" for i in range(40))
    near = base.replace("word7 ", "word7s ", 1)
    far = " ".join(f"other{i}" for i in range(40))
    texts = [f"{base}\n\nintro", f"{base.upper()}\n{far}", f"{near}\n{far} ", None, "", " ".join(f"w{i}" for i in range(1000))]
    df = docs(spark, texts)
    got = line_dedup.line_groups(df)
    rows = {(r["doc_id"], r["line_no"]): r for r in got.collect()}
    lines = [(d, k, re.sub(r"\s+", " ", x.lower()).strip()) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    assert set(rows) == {(d, k) for d, k, x in lines if x}
    assert not rows[1, 0]["kept"] and rows[1, 0]["first_doc"] == 0 and not rows[2, 1]["kept"] and rows[0, 0]["kept"]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df, got).collect()}
    assert out[0] == texts[0] and out[1] == far and out[3] is None


def test_line_fingerprints_are_word_majorities(spark):
    texts = [" ".join(f"{i % 150:03d}end{i % 7}" for i in range(400)), "a b c", "x x x y", " ".join(f"{i:03x}" for i in range(4096)), "Wording words é éa"]
    got = {r["doc_id"]: r["fp"] for r in line_dedup.fingerprints(docs(spark, texts)).collect()}
    import xxhash

    for i, t in enumerate(texts):
        h = [xxhash.xxh64_intdigest(w, 42) for w in set(t.lower().split())]
        tie = spark.range(1).select(F.xxhash64(F.lit(min(x - (x >> 63 << 64) for x in h)))).first()[0]
        want = sum((sum(x >> k & 1 for x in h) * 2 + (tie >> k & 1) > len(h)) << k for k in range(64))
        assert got[i] % (1 << 64) == want


def test_mixing(spark):
    rows = [(i, "t " * (1 + i % 7), ["en", "fr", None][i % 3], f"s{i % 4}") for i in range(400)] + [(900, None, "en", None), (901, "", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {"l": F.col("lang"), "s": F.col("source")}
    weights = {"l": F.when(F.col("l") == "en", 8).otherwise(1), "s": F.lit(1)}
    got = mixing.mix(df, levels, weights, 1200, max_epochs=2, seed=1, range_rows=8).toPandas()
    assert len(got) == len(rows)
    taken = (got.n_tokens * got.copies).sum()
    assert 1200 - 60 <= taken <= 1200 and got.copies.max() <= 2
    again = mixing.mix(df.repartition(3), levels, weights, 1200, max_epochs=2, seed=1, range_rows=1000).toPandas()
    key = ["doc_id", "copies"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert mixing.mix(df.limit(0), levels, weights, 10).count() == 0
