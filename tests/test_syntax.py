"""Content streams and object text in the JVM against the reader of files, on random input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions import syntax
from pagesift.operators import content, objects
from pagesift.pdf import syntax as reader
from pagesift.pdf.content import raw_spans
from pagesift.pdf.errors import PdfError

ATOMS = [
    "q", "Q", "BT", "ET", "/F1 12 Tf", "/F2 9.5 Tf", "14 TL", "10 -20 Td", "5 -7 TD", "1 0 0 1 50 60 Tm", "T*", "(word) Tj", "(a\\(b\\)c) Tj", "(f(g)h) Tj", "<48 656C6> Tj",
    "[(a) -100 (b) 300 <43> -250.5 (d e)] TJ", "(x) '", '1 2 (y) "', "(\\101\\7772\\n) Tj", "( ) Tj", "() Tj", "<< /A (b) /C << /D 1 >> >> BDC", "% note (x) Tj\n", "]", ">", "12 (t) Td", "(z) 3 Td", "/Im Do", "{",
    "(open \\\n line) Tj", "[] TJ", "[(p)[(q)] %c]\n (r)] TJ", "Tj", "3 Tj", "0.5 g", "é", "\x00(n)Tj",
]


def test_content_streams_equal_the_reader(spark):
    draw = random.Random(5)
    streams = ["\n".join(draw.choices(ATOMS, k=draw.randint(0, 30))).encode("latin-1") for _ in range(300)]
    streams += [b"", b"(never closed \\", b"((deep) Tj", b"<48", b"[(a) 5", b"<< /x", b"1.2.3 0 Td (a) Tj", b"(" * 20 + b"x" + b")" * 20 + b" Tj", b"(" + b"long " * 40_000 + b") Tj", b"(a) Tj " * 3000]
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(streams)], "i int, s binary").repartition(3)
    got = {r["i"]: r["x"] for r in df.select("i", content.content_spans(F.col("s")).alias("x")).collect()}
    rounded = lambda rows: [(a, b, round(x, 6), round(y, 6), e, f) for a, b, x, y, e, f in rows]
    for i, data in enumerate(streams):
        try:
            want = rounded([(j, *s) for j, s in enumerate(raw_spans(data, {}))])
        except PdfError:
            want = None
        assert (None if got[i] is None else rounded([tuple(s) for s in got[i]])) == want, data[:200]


def plain(value):
    """The reader's object in the form that the JSON has."""
    if isinstance(value, reader.Ref):
        return {"R": [value.number, value.generation]}
    if isinstance(value, reader.Name):
        return {"/": str(value)}
    if isinstance(value, bytes):
        return value.decode("latin-1")
    if isinstance(value, list):
        return [plain(v) for v in value]
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def test_objects_equal_the_reader(spark):
    draw = random.Random(9)

    def text(depth):
        kind = draw.randint(0, 9 if depth else 7)
        if kind == 8:
            return "[" + " ".join(text(depth - 1) for _ in range(draw.randint(0, 4))) + "]"
        if kind == 9:
            return "<<" + " ".join(f"/K{i}{draw.choice(['', '#20x'])} {text(depth - 1)}" for i in range(draw.randint(0, 4))) + draw.choice(["", " % note >>\n"]) + ">>"
        return [str(draw.randint(-99, 99)), f"{draw.randint(0, 9)}.5", "-.25", "true", "null", "(a\\(b\\101 \\\\)", "<48656C6>", f"{draw.randint(1, 99)} 0 R"][kind]

    texts = [text(3) for _ in range(200)] + ["/Na#20me", "[1 2", "<< /A >>", "<< 1 2 >>", "]", "foo", "", "[(x]) (>>)]", "1 0 RG", "12 0 % c\n R"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for r in df.select("i", syntax.object_json(F.col("s")).alias("j"), syntax.parse_object(F.col("s")).isNotNull().alias("v")).collect():
        data = texts[r["i"]].encode("latin-1")
        try:
            value, at = reader.value(data, 0)
            if reader.skip_blank(data, at) != len(data):
                continue
            assert r["v"] and json.loads(r["j"]) == plain(value), data
        except PdfError:
            assert r["j"] is None and not r["v"], data


@pytest.mark.parametrize("text, want", [("startxref\n12\n%%EOF", 12), ("startxref 1 startxref\r\n77", 77), ("no", None), ("startxref x", None), ("startxref 5" + " " * 2000, None), ("", None)])
def test_startxref(spark, text, want):
    df = spark.createDataFrame([(bytearray(text.encode()),)], "c binary")
    assert df.select(objects.startxref(F.col("c"))).first()[0] == want


def test_xref_sections(spark):
    text = "xref\n0 2\n0000000000 65535 f \n0000000017 00000 n \n10 1\n0000000081 00002 n \n20 0\ntrailer << >>"
    df = spark.createDataFrame([(text,), ("xref\ntrailer",), ("none",)], "t string")
    rows = [[tuple(x) for x in r[0]] for r in df.select(objects.xref_table(F.col("t"))).collect()]
    assert rows == [[(0, 0, 65535, False), (1, 17, 0, True), (10, 81, 2, True)], [], []]
