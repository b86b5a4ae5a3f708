"""File bytes to objects, objects to spans, spans to text."""

import zlib

import pytest

from pagesift.pdf.content import Span, merge_spans, page_spans, raw_spans
from pagesift.pdf.errors import PdfError
from pagesift.pdf.file import PdfFile
from pagesift.pdf.filters import ascii_hex, decode_stream, unpredict
from pagesift.pdf.fonts import Encoding, named, parse_tounicode
from pagesift.pdf.syntax import Name, Ref, Stream, tokens, value
from pagesift.plans import pdf_queries, pdf_writer


@pytest.mark.parametrize(
    "text, want",
    [
        (b"-7", -7),
        (b"0.625", 0.625),
        (b"-.5", -0.5),
        (b"false", False),
        (b"null", None),
        (b"(two\\tparts\\r)", b"two\tparts\r"),
        (b"(f(g(x))y)", b"f(g(x))y"),
        (b"(a\\)\\101\\7772)", b"a)A\xff2"),
        (b"(a\\\r\nb)", b"ab"),
        (b"<70 61676573>", b"pages"),
        (b"<48 6>", b"H\x60"),
        (b"/Two#2fParts", "Two/Parts"),
        (b"12 3 R", Ref(12, 3)),
        (b"[.5 (s) %x\n /N]", [0.5, b"s", "N"]),
        (b"[4 0 R 6 1 R 7]", [Ref(4, 0), Ref(6, 1), 7]),
        (b"<< /Width 30 /Kind /Box /Width 31>>", {"Width": 31, "Kind": "Box"}),
        (b"<< /Length 3 >> stream\r\n%ab\nendstream", Stream({"Length": 3}, b"%ab")),
        (b"<</Length 9 0 R>>stream\nabc endstream", Stream({"Length": Ref(9, 0)}, b"abc ")),
    ],
)
def test_objects(text, want):
    got = value(text, 0)[0]
    assert got == want and type(got) is (Name if isinstance(want, str) else type(want))


@pytest.mark.parametrize("text", [b"[1", b"<< /A 1", b"(a", b"<4", b"<4x>", b"+", b"wrong", b"<< 1 2 >>", b"<</Length 9>>stream\nabc endstream", b"<</A 1>> other"])
def test_bad_objects(text):
    with pytest.raises(PdfError):
        value(text, 0)


def test_tokens():
    assert [(k, v) for k, v, _ in tokens(b"[/Left 8 (up)] obj")] == [("word", "["), ("name", "Left"), ("int", "8"), ("string", "up"), ("word", "]"), ("word", "obj")]
    with pytest.raises(PdfError) as e:
        list(tokens(b"/\xff"))
    assert e.value.kind == "InvalidUtf8"


def test_filters():
    assert decode_stream({}, b"\x01\xfe as it is") == b"\x01\xfe as it is"
    assert ascii_hex(b"70 61\n67657 3>zz") == b"pages" and ascii_hex(b"4>") == b"@"
    both = {"Filter": [Name("ASCIIHexDecode"), Name("FlateDecode")]}
    assert decode_stream(both, zlib.compress(b"twice coded").hex().encode() + b">") == b"twice coded"
    for bad, kind in (({"Filter": Name("Other")}, "UnsupportedFilter"), ({"Filter": 3}, "InvalidStructure"), ({"Filter": Name("FlateDecode")}, "DecompressError")):
        with pytest.raises(PdfError) as e:
            decode_stream(bad, b"junk")
        assert e.value.kind == kind
    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1, 1, 5, 1, 1])
    assert unpredict(rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4, 5, 6, 7])


def test_fonts():
    assert named("WinAnsiEncoding").decode(b"AZ \x80\x99") == "AZ €™"
    assert named("MacRomanEncoding").decode(b"\xca\xd2\x80") == ' "Ä'
    cids = parse_tounicode(b"beginbfchar <0003><0020> <0009><00660069> endbfchar 1 beginbfrange <0024><0026><0041> <0030><0031> [<0061> <0062>] <0040><0041><D83DDE00> endbfrange")
    assert cids == {3: " ", 9: "fi", 0x24: "A", 0x25: "B", 0x26: "C", 0x30: "a", 0x31: "b", 0x40: "\U0001f600", 0x41: "\U0001f601"}
    assert Encoding(cids=cids).decode(b"\x00\x24\x00\x25xy\x00") == "ABxy\x00"


@pytest.mark.parametrize(
    "stream, want",
    [
        (b"BT /F7 9 Tf 31 420 Td (Net amount) Tj ET", [("Net amount", 31, 420, 9)]),
        (b"BT /F7 8 Tf 20 300 Td (upper) Tj 4 -15 Td (lower) Tj ET", [("upper", 20, 300, 8), ("lower", 24, 285, 8)]),
        (b"BT /F7 8 Tf 3 4 Td [(sub) -90 (total)] TJ ET", [("subtotal", 3, 4, 8)]),
        (b"BT /F7 8 Tf 3 4 Td [(left) -3000 (right)] TJ ET", [("left", 3, 4, 8), ("right", 43, 4, 8)]),
        (b"BT ] > (a) Tj (b", [("a", 0, 0, 12)]),
        (b"", []),
    ],
)
def test_content(stream, want):
    assert [tuple(s[:4]) for s in page_spans(stream)] == want


def test_saved_state_and_bad_number():
    spans = raw_spans(b"q BT /F1 8 Tf 5 6 Td (a) Tj Q (b) Tj Q ( ) Tj () Tj", {})
    assert spans == [Span("a", 5, 6, 8, "F1"), Span("b", 0, 0, 12, None), Span(" ", 6, 0, 12, None)]
    with pytest.raises(PdfError):
        raw_spans(b"1.2.3 0 Td", {})


def test_merging_keeps_the_head():
    row = lambda t, x, y=100.0, size=10.0, font="F1": Span(t, x, y, size, font)
    assert [s.text for s in merge_spans([row("ab", 0), row("cd", 10), row("ef", 26), row("gh", 60)])] == ["abcd ef", "gh"]
    assert [s.text for s in merge_spans([row("a", 0), row("b", 19), row("c", 39)])] == ["ab", "c"]
    assert [s.text for s in merge_spans([row("low", 0, 80), row("up", 0), row("other", 10, font="F2")])] == ["up", "other", "low"]
    assert merge_spans([]) == []


PAGES = [[{"text": f"Page {p} (line\\ {i}) é", "x": 50.0, "y": 700.0 - 14 * i, "font_size": 12.0, "font_name": "F1"} for i in range(4)] for p in range(5)]


@pytest.mark.parametrize("variant", pdf_writer.VARIANTS, ids="-".join)
def test_round_trip(variant):
    file = PdfFile(pdf_writer.write(PAGES, variant))
    assert [[s._asdict() for s in file.page_spans(n)] for n in range(len(file.pages))] == PAGES
    with pytest.raises(PdfError):
        file.page(5)


def test_every_damage_has_its_class():
    from pagesift.sources.pdf import parse_pages

    for name, (data, kind) in pdf_queries._damaged().items():
        assert [e["class"] for _, _, e in parse_pages(data) if e] == [kind], name


def test_revision_and_tree_cycles_end():
    good = pdf_writer.write(PAGES, ("update",))
    at = good.rfind(b"xref\n", 0, good.rfind(b"startxref"))
    first = good.find(b"xref\n")
    with pytest.raises(PdfError):
        PdfFile(good.replace(b"/Prev %d" % first, b"/Prev %d" % at))
    tree = pdf_writer.write(PAGES).replace(b"/Count 5 /Kids [", b"/Kids [2 0 R    ")
    with pytest.raises(PdfError, match="refers to itself"):
        _ = PdfFile(tree).pages


def test_reader_modes(spark):
    from pagesift import api
    from pagesift.sources import pdf

    bad = pdf_writer.write(PAGES, ("flate",)).replace(b"stream\nx", b"stream\ny", 1)
    rows = [("a", bytearray(bad)), ("b", bytearray(pdf_writer.write(PAGES))), ("none", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {(r["doc_id"], r["page_no"]): r for r in pdf.pages(files).collect()}
    assert len(got) == 11 and got["a", 0]["error"]["class"] == "DecompressError" and got["none", None]["error"]["class"] == "MissingHeader"
    assert len(got["a", 1]["spans"]) == 4
    assert pdf.pages(files, mode=pdf.DROPMALFORMED).count() == 9
    assert [r["doc_id"] for r in pdf.pages(files, page_no=4, mode=pdf.DROPMALFORMED).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="DecompressError|MissingHeader"):
        pdf.pages(files, mode=pdf.FAILFAST).collect()
    counts = {r["doc_id"]: r["page_count"] for r in api.page_counts(files).collect()}
    assert counts == {"a": 5, "b": 5, "none": None}


def test_folder_stream_and_sink(spark, tmp_path):
    from pagesift import api
    from pagesift.sources import pdf
    from pagesift.streaming import files as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pdf").write_bytes(pdf_writer.write(PAGES))
    (tmp_path / "in" / "note.txt").write_bytes(b"no")
    pages = pdf.read_pdfs(spark, str(tmp_path / "in"))
    assert pages.count() == 5
    made = pdf.write_documents(api.documents(pages, "txt"), str(tmp_path / "out"), "txt").collect()
    assert open(made[0]["file"], encoding="utf-8").read().startswith("Page 0 (line\\ 0) é Page 0")
    query = stream.write_bodies(stream.stream_pages(spark, str(tmp_path / "in")), "csv", str(tmp_path / "rows"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 5


def test_command_line(tmp_path, capsys, monkeypatch):
    from pagesift import api

    assert api.main([str(tmp_path / "none.pdf")]) == 1
    assert "cannot read" in capsys.readouterr().err
    assert api.main([]) == 1 and api.main(["--help"]) == 0
    assert capsys.readouterr().err.count("Usage:") == 2


def test_command_line_options(spark, tmp_path, capsys, monkeypatch):
    from pagesift import api

    # the command's own session would end the one of the tests
    monkeypatch.setattr(api.SparkSession, "builder", type("B", (), {"master": lambda s, *_: s, "config": lambda s, *_: s, "getOrCreate": lambda s: spark})())
    path, out = tmp_path / "a.pdf", tmp_path / "out.md"
    path.write_bytes(pdf_writer.write(PAGES))
    assert api.main([str(path), "--unknown", "--txt", "--page", "2"]) == 0
    assert capsys.readouterr().out.startswith("Page 1 (line\\ 0) é")
    assert api.main([str(path), "--md", "--page", "x", "-o", str(out)]) == 0 and out.read_text().count("Page 4") == 4
    assert api.main([str(path), "--page", "6"]) == 1 and "no page 6" in capsys.readouterr().err
    path.write_bytes(b"no file")
    assert api.main([str(path)]) == 1 and "Parse error: Invalid PDF" in capsys.readouterr().err


def test_named_calls_and_their_errors(spark):
    from pagesift import api

    bad = pdf_writer.write(PAGES, ("flate",))
    at = bad.find(b"stream\nx", bad.find(b"stream\nx") + 1)
    loop = pdf_writer.write(PAGES).replace(b"/Count 5 /Kids [", b"/Kids [2 0 R    ")
    rows = [("good", pdf_writer.write(PAGES)), ("page", bad[:at] + b"stream\ny" + bad[at + 8 :]), ("head", b"none"), ("loop", loop)]
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "path string, content binary")
    got = {r["doc_id"]: r for r in api.pdf_to_tsv(files).collect()}
    assert got["good"]["error"] is None and got["good"]["body"].count("Page") == 20
    assert got["page"]["body"] is None and got["page"]["error"].startswith("Page 2 error: Decompression failed: ")
    assert got["head"]["error"] == "Parse error: Invalid PDF: missing %PDF header"
    assert got["loop"]["error"] == "Page count error: Invalid document structure: page tree refers to itself"
    one = {r["doc_id"]: r for r in api.pdf_page_to_csv(files, 4).collect()}
    assert one["good"]["body"].count("Page 4") == 4 and one["page"]["body"] == one["good"]["body"]
    assert api.pdf_page_to_csv(files.where("path = 'good'"), 7).first()["error"] == "Page 8 error: Invalid document structure: page 7 not found"
    counts = {r["doc_id"]: (r["page_count"], r["error"]) for r in api.pdf_page_count(files).collect()}
    assert counts["good"] == (5, None) and counts["head"][1] == "Parse error: Invalid PDF: missing %PDF header"
    for call, start in ((api.pdf_to_csv, "Page 0"), (api.pdf_to_txt, "Page 0"), (api.pdf_to_md, "Page 0")):
        assert call(files.where("path = 'good'")).first()["body"].startswith(start)


def test_data_source_takes_page_filters(spark, tmp_path):
    from pyspark.sql import functions as F

    from pagesift.sources import datasource

    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.pdf").write_bytes(pdf_writer.write(PAGES))
    (tmp_path / "b.pdf").write_bytes(pdf_writer.write(PAGES[:2], ("stream",)))
    (tmp_path / "c.pdf").write_bytes(b"none")
    (tmp_path / "d.txt").write_bytes(b"none")
    datasource.register(spark)
    pages = spark.read.format("pdf").option("partition_bytes", "1").load(str(tmp_path))
    assert pages.count() == 8 and pages.rdd.getNumPartitions() == 3
    third = pages.where(F.col("page_no") == 2)
    rows = third.collect()
    assert [(r["doc_id"].rsplit("/", 1)[1], r["page_no"], len(r["spans"])) for r in rows] == [("a.pdf", 2, 4)]
    assert pages.where("error is not null").first()["error"]["class"] == "MissingHeader"
    with pytest.raises(Exception, match="MissingHeader"):
        spark.read.format("pdf").option("mode", "failfast").load(str(tmp_path)).collect()


def test_a_pushed_page_reads_only_that_page():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    from pagesift.sources.datasource import PdfReader

    reader, other = PdfReader({"path": "/x"}), GreaterThan(("page_no",), 1)
    assert list(reader.pushFilters([other, EqualTo(("page_no",), 3), EqualTo(("doc_id",), "a")])) == [other, EqualTo(("doc_id",), "a")]
    assert reader.page == 3


def test_compat_reads_as_older_readers():
    two = pdf_writer.write(PAGES, ("update",))
    assert len(PdfFile(two).pages) == 5 and PdfFile(two, compat=True).pages == []
    spaced = b"<</Length 4 0 R>>stream\n  %x\nab endstream"
    assert value(spaced, 0)[0].data == b"  %x\nab " and value(spaced, 0, True)[0].data == b"ab "
    with pytest.raises(PdfError):
        ascii_hex(b"414>", compat=True)
    assert ascii_hex(b"414", compat=True) == b"A@"
    cmap = b"beginbfchar <0009><00660069> endbfchar beginbfrange <0030><0031><D83DDE00> endbfrange"
    assert parse_tounicode(cmap, compat=True) == {9: "\0", 0x30: "\0", 0x31: "\x01"}


def test_raw_dump_heads(spark):
    from pagesift import api

    pages = spark.createDataFrame([("d", n, b) for n, b in enumerate(["", "a\n", "", "b\n"])], "doc_id string, page_no int, body string")
    assert api.whole(pages, raw=True).first()["body"] == "a\n\n--- Page 3 ---\n\n--- Page 4 ---\nb\n"
    assert api.whole(pages, raw=True, compat=True).first()["body"] == "a\n\n--- Page {} ---\n\n--- Page {} ---\nb\n"
    assert api.whole(pages).first()["body"] == "a\n\n\nb\n"
    assert api.whole(pages.where("body = ''")).first()["body"] == ""


def test_accessors():
    from pagesift.pdf import syntax as x

    given = [None, True, 3, 2.5, b"s", Name("n"), [1], {"a": 1}, Stream({"b": 2}, b"d"), Ref(1, 0)]
    assert [x.kind_of(o) for o in given] == ["null", "bool", "int", "real", "string", "name", "array", "dict", "stream", "ref"]
    want = {"as_bool": [True], "as_int": [3], "as_real": [3.0, 2.5], "as_string": [b"s"], "as_name": ["n"], "as_array": [[1]], "as_dict": [{"a": 1}, {"b": 2}], "as_stream": [({"b": 2}, b"d")], "as_ref": [Ref(1, 0)]}
    for name, found in want.items():
        assert [v for o in given if (v := getattr(x, name)(o)) is not None] == found


def test_mutated_files_only_give_error_rows():
    import random

    from pagesift.sources.pdf import parse_pages

    rng = random.Random(9)
    words = [b"<<", b">>", b"[", b"]", b"(", b"/Index 3 ", b"/W 7 ", b"/N -1 ", b"null", b"9 0 R", b"/DecodeParms << /Predictor (x) >> ", b"stream", b"-99999999999"]
    for variant in pdf_writer.VARIANTS:
        good = pdf_writer.write(PAGES[:2], variant)
        for _ in range(250):
            data = bytearray(good)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(data))
                data[at : at + rng.choice([0, 1, 5])] = rng.choice([rng.choice(words), bytes([rng.randrange(256)])])
            for number, spans, error in parse_pages(bytes(data)):
                assert (spans is None) == (error is not None)


def test_malformed_files_in_table_functions(spark):
    from pagesift.sources import pdf

    pdf.register(spark)
    boxed = pdf_writer.write(PAGES, ("stream",)).replace(b"/W [1 4 2]", b"/W [1 4 2] /Index 3")
    deep = b"%PDF-1.4\n" + b"[" * 5000 + b"\nxref\n0 1\n0000000000 65535 f \ntrailer\n" + b"[" * 5000 + b"\nstartxref\n5010\n%%EOF"
    spark.createDataFrame([("boxed", bytearray(boxed)), ("deep", bytearray(deep)), ("good", bytearray(pdf_writer.write(PAGES)))], "path string, content binary").createOrReplaceTempView("malformed")
    for call, column in (("pdf_info", "page_count"), ("pdf_objects", "kind"), ("pdf_fonts", "name"), ("pdf_spans", "text"), ("pdf_tokens", "kind")):
        got = spark.sql(f"SELECT path, t.* FROM malformed, LATERAL {call}(content) t").collect()
        assert {r["path"] for r in got if r["error"]} >= {"boxed", "deep"} - ({"boxed"} if call == "pdf_tokens" else set()), call
        assert any(r["path"] == "good" and r[column] is not None for r in got)
    assert spark.sql("SELECT t.* FROM malformed, LATERAL pdf_xref(content) t WHERE path <> 'good'").count() == 0
