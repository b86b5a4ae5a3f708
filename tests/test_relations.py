"""Ordered folds and relational forms against plain Python, and their queries against SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions import sql
from pagesift.operators import content, layout, merge, nearest, objects, render
from pagesift.operators.fold import fold
from pagesift.operators.table import table_from_spans
from pagesift.pdf.content import Span, merge_spans, raw_spans
from pagesift.plans import relational
from pagesift.schema import SPAN

TINY = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir(TINY), reason="needs the test tables")
@pytest.mark.parametrize("name", relational.QUERIES)
def test_query_equals_sql(spark, name):
    import duckdb

    for t in ("lineitem", "orders", "customer", "part", "documents"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    df = relational.QUERIES[name](spark, TINY)
    want = duckdb.sql(relational.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = sorted(map(str, df.select(*cols).toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)))
    other = sorted(map(str, want.df()[cols].astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)))
    number = lambda r: r.replace(".0,", ",").replace(".0)", ")")  # noqa: E731  a null makes pandas' integers fractions
    assert sorted(map(number, rows)) == sorted(map(number, other)) and rows
    assert "Python" not in plan_of(df) and "CartesianProduct" not in plan_of(df)


def mixed_pages(n):
    draw, pages = random.Random(2), []
    for _ in range(n):
        spans = []
        for line in range(draw.randint(0, 5)):
            size, x = draw.choice([8.0, 10.0, 12.0]), 50.0
            for _ in range(draw.randint(1, 25)):
                t = draw.choice(["a", "b", " ", "word", "two words", "🙂", ""])
                spans.append(Span(t, round(x, 2), 700.0 - line * 20 + draw.choice([0, 0, 0.5, 1.0, -0.7]), draw.choice([size, size, 8.0]), draw.choice(["F1", "F1", "F1", "F2", None])))
                x += draw.choice([0.5, 0.5, 0.5, 1, 2.5]) * size * len(t) * 0.9 + draw.choice([0, 0, 3, 9, 20, -4])
        draw.shuffle(spans)
        pages.append(spans)
    return pages


def frame(spark, pages):
    return spark.createDataFrame([(i, [(j, *s) for j, s in enumerate(p)]) for i, p in enumerate(pages)], f"i int, spans array<{SPAN}>")


def test_merging_equals_a_loop(spark):
    pages = mixed_pages(150)
    df = frame(spark, pages).select("i", merge.merge_spans(F.col("spans")).alias("m"))
    got = {r["i"]: [tuple(s) for s in r["m"]] for r in df.collect()}
    for i, p in enumerate(pages):
        assert got[i] == [(j, *s) for j, s in enumerate(merge_spans(p))]


def test_lines_of_chained_baselines_have_an_order(spark):
    """Each span is near the next one, and none the same as all: sorting by pairs has no answer."""
    page = [Span(c, 10.0 * i, 700.0 - 2 * i, 10.0, "F1") for i, c in enumerate("abcdefgh")]
    rows = frame(spark, [page, page[::-1]]).select("i", F.transform(merge.line_order(F.col("spans")), lambda s: s["text"]).alias("t")).collect()
    assert [r["t"] for r in rows] == [list("abcdefgh")] * 2


def test_fold_is_linear_in_what_it_emits(spark):
    step = lambda s, x: F.struct((s + x).alias("state"), F.when(x % 3 == 0, F.array(s)).otherwise(F.expr("cast(array() as array<bigint>)")).alias("out"))
    for n in (0, 1, 64, 65, 20_000):
        r = spark.range(1).select(fold(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")) if n else F.expr("cast(array() as array<bigint>)"), F.lit(0).cast("long"), step, "bigint").alias("r")).first()["r"]
        assert r["state"] == n * (n + 1) // 2 and r["out"] == [k * (k - 1) // 2 for k in range(3, n + 1, 3)]


def test_operators_equal_the_stream_reader(spark):
    draw = random.Random(6)
    pages, streams = [], []
    for _ in range(80):
        ops, stream = [], []
        for _ in range(draw.randint(0, 40)):
            op = draw.choice(["q", "Q", "BT", "ET", "Tf", "TL", "Td", "TD", "Tm", "T*", "Tj", "Tj", "TJ", "'", '"', "Td1", "re"])
            nums, name, text, items = [], None, None, None
            if op == "Tf":
                nums, name = [float(draw.randint(5, 20))], draw.choice(["F1", "F2"])
            elif op == "TL":
                nums = [float(draw.randint(5, 20))]
            elif op in ("Td", "TD"):
                nums = [float(draw.randint(-9, 99)), float(draw.randint(-99, 9))]
            elif op == "Td1":
                op, nums = "Td", [4.0]
            elif op == "Tm":
                nums = [1.0, 0.0, 0.0, 1.0, float(draw.randint(0, 500)), float(draw.randint(0, 500))]
            elif op in ("Tj", "'", '"'):
                text = draw.choice(["word", " two ", " ", "", "x"])
            elif op == "TJ":
                items = [(draw.choice(["ab", "c", " ", ""]), None) if draw.random() < 0.6 else (None, float(draw.choice([-100, 150, -300, 900]))) for _ in range(draw.randint(0, 6))]
            ops.append((len(ops), op, nums, name, text, items))
            shown = [*(["/" + name] if name else []), *map(str, nums), *([f"({text})"] if text is not None else [])]
            if items is not None:
                shown.append("[" + " ".join(f"({t})" if t is not None else str(k) for t, k in items) + "]")
            stream.append(" ".join([*shown, op]))
        pages.append(ops)
        streams.append("\n".join(stream).encode())
    schema = "p int, seq int, op string, nums array<double>, name string, text string, items array<struct<text:string,kern:double>>"
    df = spark.createDataFrame([(i, *o) for i, p in enumerate(pages) for o in p], schema).repartition(3)
    got = {r["p"]: [tuple(s) for s in r["spans"]] for r in content.pages_of_operators(df, "p").collect()}
    for i, data in enumerate(streams):
        want = [(j, *s) for j, s in enumerate(raw_spans(data, {}))]
        rounded = lambda rows: [(a, b, round(x, 6), round(y, 6), e, f) for a, b, x, y, e, f in rows]
        assert rounded(got.get(i, [])) == rounded(want), data


def test_nearest_without_a_product(spark):
    draw = random.Random(3)
    points = [(k, float(draw.randint(0, 50)), i) for k in range(6) for i in range(40)] + [(None, 3.0, 1)]
    marks = [(k, float(draw.randint(0, 50)), i) for k in range(5) for i in range(k + 1)]
    df = nearest.nearest(spark.createDataFrame(points, "k int, x double, i int"), spark.createDataFrame(marks, "k int, x double, m int"), ["k"], "x", "m")
    for r in df.collect():
        near = sorted((abs(x - r["x"]), x, m) for k, x, m in marks if k == r["k"])
        assert r["m"] == (near[0][2] if near else None)
    assert df.count() == len(points) and "CartesianProduct" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_references(spark):
    known = spark.createDataFrame([(d, n) for d in (1, 2) for n in range(1, 8)], "doc_id int, number int")
    edges = [(1, 1, "A", 2), (1, 2, "B", 3), (1, 3, "Up", 1), (1, 3, "Gone", 99), (1, 5, "Own", 5), (1, 5, "To", 6), (2, 1, "A", 7), (2, 7, "A", 7), (1, 1, "C", 3)]
    edges = spark.createDataFrame(edges, "doc_id int, owner int, key string, target int")
    assert objects.resolve(edges, known).count() == 8
    assert [tuple(r) for r in objects.dangling(edges, known).select("doc_id", "owner", "key", "target").collect()] == [(1, 3, "Gone", 99)]
    found = objects.reachable(objects.resolve(edges, known), known.where("number = 1"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0), (2, 7, 1)]
    assert objects.reachable(edges, known.where("false")).collect() == []


def test_page_order_of_deep_unbalanced_and_cyclic_trees(spark):
    deep = [("deep", n, "Pages") for n in range(1, 31)] + [("deep", 1000 + n, "Page") for n in range(1, 31)]
    kids = [("deep", n, 1, n + 1) for n in range(1, 30)] + [("deep", n, 2, 1000 + n) for n in range(1, 31)]
    nodes = [*deep, ("odd", 1, "Pages"), ("odd", 2, "Page"), ("odd", 3, "Pages"), ("odd", 4, "Page"), ("odd", 5, None), ("odd", 6, "Pages")]
    kids += [("odd", 1, 0, 3), ("odd", 1, 1, 2), ("odd", 1, 2, 5), ("odd", 1, 10, 4), ("odd", 3, 0, 1), ("odd", 3, 1, 4), ("odd", 1, 3, 77), ("odd", 2, 0, 4), ("odd", 1, 4, 6)]
    out = objects.page_order(
        spark.createDataFrame(nodes, "doc_id string, number int, kind string"), spark.createDataFrame(kids, "doc_id string, parent int, place int, child int"), spark.createDataFrame([("deep", 1), ("odd", 1), ("none", 1)], "doc_id string, number int")
    )
    rows = {}
    for r in sorted(out.collect(), key=lambda r: (r["doc_id"], r["page_no"])):
        rows.setdefault(r["doc_id"], []).append(r["number"])
    assert rows == {"odd": [4, 2, 4], "deep": [1000 + n for n in range(30, 0, -1)]}


@pytest.mark.parametrize("widths", [[1, 2, 1], [0, 4, 0], [1, 3, 2], [2, 0, 4], [0, 1, 0]])
def test_binary_records(spark, widths):
    draw = random.Random(sum(widths))
    records = [[draw.randrange(256**w) if w else None for w in widths] for _ in range(9)]
    data = b"".join(v.to_bytes(w, "big") for r in records for v, w in zip(r, widths, strict=True) if w) + b"\1" * (sum(widths) - 1)
    ranges = [(5, 4), (100, 0), (200, 50)]
    df = spark.createDataFrame([(bytearray(data), widths, ranges)], "data binary, w array<int>, r array<struct<first:bigint,count:bigint>>")
    got = [tuple(r) for r in df.select(F.explode(objects.xref_records(F.col("data"), F.col("w"), F.col("r")))).select("col.*").collect()]
    numbers = [5, 6, 7, 8, *range(200, 205)]
    assert got == [(n, 1 if k is None else k, a or 0, b or 0) for n, (k, a, b) in zip(numbers, records, strict=True)]
    bad = df.select(objects.xref_records(F.col("data"), F.array(F.lit(0), F.lit(0), F.lit(0)), F.col("r")).alias("a"), objects.xref_records(F.col("data"), F.array(F.lit(1), F.lit(1)), F.col("r")).alias("b")).first()
    assert bad["a"] is None and bad["b"] is None


def test_codes_through_a_table_of_maps(spark):
    maps = spark.createDataFrame([("A", 36, "x"), ("A", 37, "ffi"), ("B", 36, "y")], "font string, code int, letter string")
    texts = [(1, "A", b"\0\x24\0\x25\0\x26"), (2, "B", b"\0\x24\0"), (3, "none", b"\0\x24"), (4, "A", b""), (5, None, b"Z"), (6, "A", None)]
    df = nearest.decode_codes(spark.createDataFrame(texts, "id int, font string, codes binary"), maps, F.col("codes"), "id", "font")
    assert dict(map(tuple, df.collect())) == {1: "xffi\0&", 2: "y\0", 3: "\0$", 4: "", 5: "Z", 6: ""}


def test_sql_functions_are_the_columns(spark):
    sql.register(spark)
    pages = frame(spark, mixed_pages(25)).select("i", merge.merge_spans(F.col("spans")).alias("spans"))
    pages.createOrReplaceTempView("pages_to_call")
    got = spark.sql("SELECT i, spans_to_csv(spans) AS a, spans_to_text(spans_drop_blank(spans)) AS b, elements_to_markdown(spans_elements(spans)) AS c FROM pages_to_call")
    want = pages.select("i", render.to_csv(table_from_spans(F.col("spans"))).alias("a"), render.to_text(table_from_spans(F.col("spans"))).alias("b"))
    want = want.join(layout.classify_spans(pages).select("i", render.elements_to_markdown(F.col("elements")).alias("c")), "i")
    blank = lambda rows: sorted(tuple(r[c] or "" for c in ("a", "b", "c")) for r in rows)
    assert blank(got.collect()) == blank(want.collect())
    assert "spans_to_csv" not in got._jdf.queryExecution().optimizedPlan().toString().split("AS a")[0]
    one = spark.sql("SELECT csv_row_count('a,b\n1,2\n') AS n, format_size(1536) AS s, decode_codes(unhex('0003'), parse_tounicode('1 beginbfchar <0003> <0041> endbfchar')) AS t").first()
    assert tuple(one) == (1, "1.5 KB", "A")
