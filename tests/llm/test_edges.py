"""Empty tables, nulls in any column, repeated rows and clashing extra columns for
every corpus operator, and fuzzy lines and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pagesift.llm import ann, bpe_tree, exact_dedup, html_wrapper, langid, line_dedup, mixing, queries, simhash, token_count, warc

public = pytest.importorskip("public_tokenizers")
JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")

#: Names that the operators use inside, as columns of the input.
CLASH = ["fp", "k", "key", "name", "level", "group_size", "kept", "text_sha256", "component_id", "copies", "n_tokens", "lang_pred", "score", "_id", "_lang", "html_text", "digest", "first", "list", "rank"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
PAGES = "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in CLASH)
VECS = "vec_id long, embedding array<float>, label string, " + ", ".join(f"{c} string" for c in CLASH if c != "label")


def mix(df):
    return queries.mix_documents(df, 0.5, max_epochs=2)


#: Each operator over the documents, with the columns of its result.
ON_DOCS = {
    "language": langid.identify,
    "tokens": lambda df: token_count.token_counts(df, JSON, public.PATTERN),
    "simhash": simhash.simhash_components,
    "lines": line_dedup.line_groups,
    "mix": mix,
    "exact": exact_dedup.exact_dedup,
    "bpe": lambda df: bpe_tree.encode_digests(df, RANKS, public.PATTERN),
}


def clash(n):
    return [f"x{i}" for i in range(n)]


def doc_rows():
    """Nulls in every column, repeated rows, repeated ids, ties."""
    extra = clash(len(CLASH))
    rows = [(i, f"the thing number {i % 3}\nand more", "en", "src0", 9, *extra) for i in range(6)]
    rows += [(7, None, "en", "src1", None, *extra), (8, "", None, None, 0, *extra), (None, "no id here", "en", None, 1, *extra), (None, None, None, None, None, *[None] * len(CLASH))]
    rows += [rows[0], rows[0], (1, "another text of the same id", "de", "src0", 2, *extra)]
    return rows


@pytest.mark.parametrize("name", ON_DOCS)
def test_documents_empty_odd_and_plain(spark, name):
    op, rows = ON_DOCS[name], doc_rows()
    assert op(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame(rows, DOCS)
    got = op(df)
    out = sorted(map(str, got.collect()))
    if name == "lines":
        worded = sum(bool(x.strip()) for r in rows for x in (r[1] or "").split("\n"))
        assert len(out) == worded
    else:
        assert len(out) == len(rows)
    # what the other columns hold changes nothing
    plain = op(df.select("doc_id", "text", "lang", "source"))
    assert plain.columns == got.columns and sorted(map(str, plain.collect())) == out
    # all nulls
    alone = spark.createDataFrame([rows[9]], DOCS)
    assert op(alone).count() == (0 if name == "lines" else 1)


def test_pages_empty_odd_and_plain(spark):
    extra = clash(len(CLASH))
    rows = [(1, "http://a/1", "<p>one</p>", *extra), (1, "http://a/1", "<p>one</p>", *extra), (None, None, "<p>one</p>", *extra), (None, None, None, *[None] * len(CLASH)), (4, "no url at all", "<<<>&#xFFFFFFFF;&amp<p", *extra), (5, "http://a/2", "<div>" * 3000 + "deep" + "</div>" * 3000, *extra), (6, "http://a/3", "<p>" + "long " * 300_000, *extra)]
    df = spark.createDataFrame(rows, PAGES)
    for op in (html_wrapper.extract_text, warc.archive_digest):
        assert op(spark.createDataFrame([], PAGES)).collect() == []
        got = sorted(map(str, op(df).drop("bundle", "frame", "offset").collect()))
        assert len(got) == len(rows)
        assert sorted(map(str, op(df.select("page_id", "url", "html")).drop("bundle", "frame", "offset").collect())) == got
    text = {r["page_id"]: r["text"] for r in html_wrapper.extract_text(df).where("page_id > 4").collect()}
    assert text[5] == "deep" and text[6] == ("long " * 300_000).strip()


def test_vectors_empty_odd_and_ties(spark):
    extra = clash(len(CLASH))
    rows = [(i, [1.0, 0.0], "a", *extra) for i in range(45)] + [(100, [], "a", *extra), (120, None, None, *[None] * len(CLASH)), (None, [1.0, 1.0], "a", *extra), (140, [float("inf"), 1.0], "a", *extra)]
    df = spark.createDataFrame(rows, VECS)
    assert ann.search(spark.createDataFrame([], VECS)).collect() == []
    got = ann.search(df).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20))
    assert ann.search(spark.createDataFrame(rows[:2], VECS)).collect() == [(0, 1, 1, 1.0)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def components(nodes, linked):
    """Each node's smallest node, by repeated relabelling."""
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def brute_lines(rows, bands=None):
    """The line that names each line's group, by comparing every two lines; ``rows`` are of
    id and text. Lines are known by content, so an id may repeat or be null."""
    from xxhash import xxh64_intdigest

    lines = []
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            x = re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
            if x:
                lines.append((d, k, x))
    first = {}
    for d, k, x in lines:
        at = (d is None, d or 0, k)
        first[x] = min(at, first.get(x, at))
    fp = {}
    for x in first:
        h = [xxh64_intdigest(w, 42) for w in set(x.split(" "))]
        tie = xxh64_intdigest((min(y - (y >> 63 << 64) for y in h) % (1 << 64)).to_bytes(8, "little"), 42)
        fp[x] = sum((sum(y >> k & 1 for y in h) * 2 + (tie >> k & 1) > len(h)) << k for k in range(64))
    masks = [m % (1 << 64) for m in line_dedup.masks_for(line_dedup.RADIUS, bands or line_dedup.BANDS)]
    name = {x: (first[x], hashlib.md5(x.encode()).digest(), x) for x in first}
    links = []

    def blocks(x):
        w, n = x.split(" "), line_dedup.BLOCK
        return {(i, *w[at : at + n]) for i, at in enumerate((0, n, len(w) - n, len(w) - 2 * n)) if len(w) >= (n, 2 * n, n, 2 * n)[i]}

    for x, y in combinations(first, 2):
        differ = fp[x] ^ fp[y]
        if differ.bit_count() <= line_dedup.REACH and (any(not differ & m for m in masks) or blocks(x) & blocks(y)) and 1 - edit_distance(x, y) / max(len(x), len(y)) >= 0.8 - 1e-9:
            links.append((name[x], name[y]))
    root = components(name.values(), links)
    out = Counter()
    for d, k, x in lines:
        (none, lead, line), _, of = root[name[x]]
        out[d, k, None if none else lead, line, of == x and (d is None, d or 0, k) == (none, lead, line)] += 1
    return out, len(links)


def line_rows():
    random.seed(11)
    words = [f"{random.choice('abcdefgh')}{random.choice('klmnop')}{i}" for i in range(400)]
    texts = []
    for g in range(14):
        base = random.choices(words, k=random.choice([3, 30, 60]))
        chain = list(base)
        for _ in range(7):
            # a chain: each line differs in one word from the one before it
            chain = list(chain)
            chain[random.randrange(len(chain))] = random.choice(words)
            texts.append("\n".join([" ".join(chain), random.choice(["", "  ", "Same  END", "same end ", f"tail {g}"])]))
    texts += [None, "", "\n\n", " ".join(random.choices(words, k=300))]
    # same words in another order: equal fingerprints, unlike lines
    mixed = random.sample(words, 40)
    texts += [" ".join(mixed), " ".join(reversed(mixed)), " ".join(mixed[20:] + mixed[:20])]
    random.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("how", [{"lead": False}, {"lead": True}, {"bands": 5}, {"bands": 7}])
def test_lines_against_brute_force(spark, how):
    rows = line_rows()
    # ids that repeat with other lines at the same places, and rows without an id
    rows += [(d, rows[-1 - d][1]) for d in range(9)] + [(None, t) for _, t in rows[20:30]] + [rows[40], rows[40]]
    want, links = brute_lines(rows, how.get("bands"))
    assert links > 10
    got = line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    assert Counter((r["doc_id"], r["line_no"], r["first_doc"], r["first_line"], r["kept"]) for r in got) == want


def test_lines_of_documents_that_share_an_id(spark):
    base = " ".join(f"plain{i}" for i in range(30))
    other = "a totally different unrelated sentence about cheese"
    rows = [(0, base), (5, base.replace("plain7 ", "plains7 ")), (5, other), (None, base), (None, other + "!\nown line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(str, (r["text"] for r in line_dedup.drop_lines(df, line_dedup.line_groups(df)).collect())))
    assert out == sorted([base, "", other, "", "own line"])  # a sign more is alike, too


def test_lines_found_of_all_that_are_alike(spark):
    """Pairs of edit similarity 0.8 or more alone decide what should be found."""
    random.seed(4)
    letters = "abcdefghiklmnoprstuw"
    word = lambda: "".join(random.choices(letters, k=random.randint(2, 8)))
    rows, changed = [], 0
    for d in range(200):
        words = [word() for _ in range(random.randint(15, 80))]
        near = list(words)
        for _ in range(random.randint(1, max(1, len(words) // 15))):
            near[random.randrange(len(near))] = word()
        alike = 1 - edit_distance(" ".join(words), " ".join(near)) / max(len(" ".join(words)), len(" ".join(near))) >= 0.8
        changed += alike
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(near))]
    got = line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = [r for r in got if not r["kept"]]
    assert all(r["first_doc"] == r["doc_id"] - 1 and r["doc_id"] % 2 for r in gone)
    assert changed > 180 and len(gone) >= 0.9 * changed


def brute_mix(rows, budget_share):
    """Documents taken: budgets by repeated dealing, then prefixes by one sort a leaf."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaf = lambda r: ("crawl" if r[3] == "src0" else "books" if r[3] in queries.BOOKS else "web", r[2] or "(none)", r[3] or "(none)")
    weigh = [lambda p: 4 if p[0] == "books" else 3, lambda p: {"en": 6, "de": 3}.get(p[1], 2), lambda p: 1]
    members = defaultdict(list)
    for r in rows:
        members[leaf(r)].append((r[0], count(r[1])))
    supply = {x: sum(n for _, n in m) for x, m in members.items()}
    given = {(): int(sum(supply.values()) * budget_share)}
    for depth in range(3):
        below = {}
        for parent, budget in given.items():
            cap = Counter()
            for x, n in supply.items():
                if x[:depth] == parent:
                    cap[x[: depth + 1]] += n
            todo, left = dict(cap), budget
            while todo:
                w = {x: weigh[depth](x) for x in todo}
                full = [x for x in todo if todo[x] * sum(w.values()) <= w[x] * left]
                if not full:
                    below |= {x: w[x] * left // sum(w.values()) for x in todo}
                    break
                for x in full:
                    below[x] = todo[x]
                    left -= todo.pop(x)
        given = below
    taken = set()
    for x, m in members.items():
        whole = supply[x] and given[x] // supply[x]
        left = given[x] % supply[x] if supply[x] else 0
        if whole:
            taken |= {d for d, _ in m}
        run = 0
        for d, n in sorted(m, key=lambda y: hashlib.md5(f"17:{whole}:{y[0]}".encode()).hexdigest()):
            run += n
            if left and run <= left:
                taken.add(d)
    return taken


def pipeline_rows():
    random.seed(8)
    roots = {"en": ["the", "ing", "er", "wh"], "fr": ["eau", "é", "ou", "qu"], "de": ["sch", "ung", "ü", "ei"]}
    word = lambda g: "".join(random.choices(roots[g], k=3))
    rows = []
    for i in range(240):
        g = random.choice(list(roots))
        rows.append((i, " ".join(word(g) for _ in range(random.choice([40, 80, 160]))), g, f"src{i % 9}"))
    for i in range(60):
        of = rows[random.randrange(200)]
        words = of[1].split(" ")
        if i % 2:
            words[random.randrange(len(words))] = word(of[2])
        rows.append((300 + i, ("  " if i % 3 else " ").join(words), of[2], f"src{i % 9}"))
    rows += [(500, None, "en", "src0"), (501, "", "de", None), (502, "123 456 !!", None, "src1"), (503, rows[3][1] + "\t" + word("en"), None, None)]
    random.shuffle(rows)
    return rows


def test_pipeline_against_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline_rows()
    extra = clash(len(CLASH))
    df = spark.createDataFrame([(*r, 1, *extra) for r in rows], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}

    model = langid.train(df)
    labels, scores = model.predict([r[1] for r in rows])
    rows = [r for r, g, s in zip(rows, labels, scores, strict=True) if g != "und" and s >= pipeline.MIN_SCORE]
    assert {500, 501, 502}.isdisjoint(r[0] for r in rows)
    seen = {}
    for r in sorted(rows):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    exact = list(seen.values())
    fp = {r[0]: simhash.fingerprint(r[1]) for r in exact}
    root = components(fp, [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    near = [r for r in exact if root[r[0]] == r[0]]
    assert len(near) < len(exact) < len(rows)
    taken = brute_mix(near, pipeline.MIX_BUDGET)
    assert 0 < len(taken) < len(near)
    assert set(got) == taken
    codec = bpe_tree.TreeCodec(RANKS, public.PATTERN)
    for r in near:
        if r[0] in taken:
            ids = codec.encode(r[1])
            assert got[r[0]]["ids_sha256"] == hashlib.sha256(ids).hexdigest() and got[r[0]]["n_tokens"] * 4 == len(ids)
            assert got[r[0]]["decoded_sha256"] == hashlib.sha256(r[1].encode()).hexdigest()


def test_pipeline_stages_pass_columns_through_and_take_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    extra = clash(len(CLASH))
    rows = [(*r, 1, *extra) for r in pipeline_rows()] + [(None, "the ing er whing theer inger the whwh", "en", None, None, *[None] * len(CLASH))]
    rows += [rows[0], rows[0]]
    df, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)
    whole = {r: n for r, n in Counter(map(tuple, rows)).items()}
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).columns == df.columns
        assert stage(spark, none, str(tmp_path)).collect() == []
        out = stage(spark, df, str(tmp_path))
        left = Counter(map(tuple, out.collect()))
        assert out.columns == df.columns and 0 < left.total() < len(rows), name
        assert all(n <= whole[r] for r, n in left.items()), name
        if name in ("langid", "exact", "near"):
            assert any(r[0] is None for r in left), name
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_mixing_of_weightless_and_wordless_leaves(spark):
    rows = [(1, "a b", "x"), (2, "c", "y"), (3, None, "z"), (4, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, s string")
    got = mixing.mix(df, {"s": F.col("s")}, {"s": F.when(F.col("s") == "x", 0).otherwise(1)}, 10, max_epochs=3).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == {1: 0, 2: 3, 3: 0, 4: 0}


def test_mixing_of_rows_without_an_id(spark):
    """They take the budget's prefix like others, spread by their token counts."""
    rows = [(None, "w " * (1 + i % 50), "x") for i in range(300)] + [(i, "w " * 10, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s string")
    levels, weights = {"s": F.col("s")}, {"s": F.lit(1)}
    got = mixing.mix(df, levels, weights, 4000, seed=3, range_rows=20).collect()
    assert len(got) == 350 and 4000 - 50 <= sum(r["n_tokens"] * r["copies"] for r in got) <= 4000
    carried = mixing.mix(df, levels, weights, 4000, seed=3, range_rows=20, carry=True).collect()
    assert all(len(r["row"]["text"].split()) == r["n_tokens"] and r["row"]["doc_id"] == r["doc_id"] for r in carried)
    assert sorted(str((r["doc_id"], r["n_tokens"], r["copies"])) for r in carried) == sorted(str((r["doc_id"], r["n_tokens"], r["copies"])) for r in got)


def test_counts_of_texts_longer_than_a_segment(spark):
    import tiktoken
    from tokenizers import Tokenizer

    from pagesift.llm import pieces

    random.seed(12)
    text = " ".join(random.choice(["word", "Wörter", "12 345", "x" * 300, "\n\n", "don't"]) for _ in range(40_000))
    assert len(text) > 8 * pieces.SEGMENT
    df = spark.createDataFrame([(None, text)], "doc_id long, text string")
    assert token_count.token_counts(df, JSON, public.PATTERN).first()["n_tokens"] == len(Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids)
    codec = bpe_tree.TreeCodec(RANKS, public.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = enc.encode_ordinary(text)
    got = bpe_tree.encode_digests(df, RANKS, public.PATTERN).first()
    assert got["n_tokens"] == len(want) and got["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()


def test_a_cluster_needs_a_named_folder(spark, monkeypatch):
    from pagesift.llm import common

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_scratch_tables_go(spark):
    from pagesift.llm import common

    with common.scratch() as keep:
        one = common.materialize(spark.range(3), "one")
        two = common.materialize(spark.range(4), "two")
        keep(two)
    assert two.count() == 4 and one._pagesift_path not in common._written
    common.release(two)


def test_lines_are_linked_whatever_other_lines_there_are(spark, monkeypatch):
    """The same groups with many more lines around, and with large keys dealt to shares."""
    draw = random.Random(12)
    vocabulary = [f"word{i}" for i in range(400)]
    lines = []
    for _ in range(60):
        words = draw.choices(vocabulary, k=25)
        for _ in range(3):
            lines.append(" ".join(words))
            words = [draw.choice(vocabulary) if draw.random() < 0.05 else w for w in words]
    docs = [(i, t) for i, t in enumerate(lines)]
    more = [(10_000 + i, " ".join(draw.choices([f"other{j}" for j in range(900)], k=draw.randint(4, 30)))) for i in range(3000)]

    def groups(rows, **how):
        out = line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
        return {r["doc_id"]: r["first_doc"] for r in out if r["doc_id"] < 10_000}

    want = groups(docs)
    assert len(set(want.values())) < 170
    assert groups(docs + more) == want
    monkeypatch.setattr(line_dedup, "_SHARE", 3)
    assert groups(docs + more, lead=False) == want


def test_pipeline_stages_take_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    names = ["lang_pred", "_lang_pred", "lang_score", "lang_strange", "text_sha256", "_text_sha256", "kept_doc_id", "_kept_doc_id", "kept_text_sha256", "Kept_Doc_Id2"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, f"the old house number {i % 7} of the town", "en", "src0", 9, *["x"] * len(names)) for i in range(30)] + [(40, None, "en", "src0", 0, *["y"] * len(names))]
    df = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.language, corpus_pipeline.exact, corpus_pipeline.near):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and 0 < out.count() <= len(rows)
    gone = line_dedup.line_groups(df)
    wide = df.withColumn("gone", F.lit(1)).withColumn("gone_of", F.lit(2))
    assert line_dedup.drop_lines(wide, gone).columns == wide.columns


def test_long_runs_of_one_sign():
    """No place of such a piece is stable, so whole halves are merged again."""
    import time

    import tiktoken

    codec = bpe_tree.TreeCodec(RANKS, public.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    began = time.process_time()
    for text in ("=" * 20_000, "-=" * 5000, "ab" * 9000, "".join(random.Random(3).choices("abcde=", k=9000))):
        assert codec.encode(text) == b"".join(t.to_bytes(4, "little") for t in enc.encode_ordinary(text))
    assert time.process_time() - began < 60
