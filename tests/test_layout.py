"""Small cases of clustering, tables, layout and renderings."""

from pyspark.sql import functions as F

from pagesift.functions import text as T
from pagesift.operators import cluster, layout, render
from pagesift.operators.table import table_from_spans
from pagesift.schema import SPAN


def page(spark, *spans):
    """Spans are (text, x, y, size)."""
    rows = [(i, t, float(x), float(y), float(s), None) for i, (t, x, y, s) in enumerate(spans)]
    return spark.createDataFrame([(rows,)], f"spans array<{SPAN}>")


def one(df, c):
    return df.select(c.alias("v")).first()["v"]


def test_grid_and_csv(spark):
    df = page(spark, ("A", 0, 100, 12), ("B", 50, 100, 12), ("1", 0, 80, 12), ("2", 50, 80, 12))
    t = one(df, table_from_spans(F.col("spans")))
    assert t["num_columns"] == 2 and t["rows"] == [["A", "B"], ["1", "2"]]
    assert one(df, render.to_tsv(table_from_spans(F.col("spans")))) == "A\tB\n1\t2"
    quoted = page(spark, ("Test, Item", 0, 100, 12), ("123", 50, 100, 12))
    assert one(quoted, render.to_csv(table_from_spans(F.col("spans")))) == '"Test, Item",123'


def test_row_tolerance(spark):
    df = page(spark, ("a", 0, 100, 12), ("b", 9, 100.5, 12), ("c", 0, 80, 12))
    assert [len(r) for r in one(df, cluster.cluster_rows(F.col("spans"), F.lit(6.0)))] == [2, 1]


def test_anchored_and_chained_differ(spark):
    df = page(spark, ("a", 0, 10, 10), ("b", 8, 10, 10), ("c", 16, 10, 10))
    assert one(df, cluster.x_clusters(F.col("spans"))) == 2
    assert len(one(df, cluster.detect_columns(F.col("spans")))) == 1


def test_nearest_column_tie_is_left(spark):
    df = spark.createDataFrame([([0.0, 10.0],)], "c array<double>")
    assert one(df, cluster.nearest_column(F.lit(5.0), F.col("c"))) == 0


def test_elements(spark):
    df = page(spark, ("Title", 50, 700, 24), ("first line", 50, 660, 12), ("second", 50, 646, 12), ("x", 50, 600, 12), ("y", 200, 600, 12), ("z", 350, 600, 12), ("1", 50, 586, 12), ("2|", 200, 586, 12), ("3", 350, 586, 12))
    df = layout.classify_spans(df)
    e = df.first()["elements"]
    assert [(x["kind"], x["level"]) for x in e] == [("heading", 1), ("paragraph", 0), ("table", 0)]
    assert e[1]["text"] == "first line second"
    md = one(df, render.elements_to_markdown(F.col("elements")))
    assert md == "# Title\n\nfirst line second\n\n| x   | y   | z   |\n| --- | --- | --- |\n| 1   | 2\\| | 3   |\n"
    assert one(df, render.elements_to_txt(F.col("elements"))).startswith("Title\n\nfirst line second\n\nx")


def test_empty_page(spark):
    df = layout.classify_spans(page(spark, (" ", 0, 0, 10)))
    assert df.first()["elements"] == []
    assert one(df, render.elements_to_txt(F.col("elements"))) == ""
    assert one(df, render.to_text(table_from_spans(F.col("spans")))) == ""


def test_body_size_tie_is_larger(spark):
    df = page(spark, ("abc", 0, 10, 10), ("xyz", 0, 30, 12))
    assert one(df, layout.body_font_size(F.col("spans"))) == 12.0


def test_join_pages(spark):
    df = spark.createDataFrame([(["", "a", "", "b"],)], "p array<string>")
    assert one(df, render.join_pages(F.col("p"))) == "a\n\nb"


def test_codecs(spark):
    df = spark.createDataFrame([(bytes([0x41, 0x80, 0x99, 0xCA]), "48 65 6C6C 6F>", "F")], "b binary, h string, odd string")
    assert one(df, T.winansi(F.col("b"))) == "A€™Ê"
    assert one(df, T.macroman(F.col("b"))) == "AÄô "
    assert one(df, T.ascii_hex_decode(F.col("h"))) == b"Hello"
    assert one(df, T.ascii_hex_decode(F.col("odd"))) == b"\xf0"
    assert one(df, T.utrim(F.lit(" a\x1c "))) == "a\x1c"


def test_character_map(spark):
    cmap = "1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0024> <0026> <0041> <0030> <0031> [<0061> <0062> <0063>] endbfrange"
    df = spark.createDataFrame([(cmap, bytes.fromhex("00240025000300990130".replace("0130", "7A")))], "m string, b binary")
    m = one(df, T.parse_tounicode(F.col("m")))
    assert m == {3: " ", 0x24: "A", 0x25: "B", 0x26: "C", 0x30: "a", 0x31: "b"}
    assert one(df, T.decode_bytes(F.col("b"), T.parse_tounicode(F.col("m")))) == "AB \x00\x99z"


def test_csv_back_to_rows(spark):
    from pagesift.functions.csv import csv_rows, format_size, row_count

    text = 'h1,"h,2"\r\n\n,,\n"a ""b""","x\r\ny"\r\nlast'
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df, csv_rows(F.col("t"))) == [["h1", "h,2"], ['a "b"', "x\r\ny"], ["last"]]
    assert one(df, row_count(F.col("t"))) == 2 and one(df, row_count(F.lit(""))) == 0
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 1075: "1.0 KB", 1 << 20: "1.0 MB", (1 << 20) * 5 // 4: "1.3 MB", 123456789012: "117737.6 MB"}
    assert {n: one(df, format_size(F.lit(n).cast("long"))) for n in sizes} == sizes


def test_keyword_rows_and_slices(spark):
    from pagesift.operators import table

    df = page(spark, ("Due Date", 0, 100, 12), ("x", 150, 100, 12), ("1", 0, 80, 12), ("total", 0, 60, 12), ("9", 150, 60, 12))
    t = table_from_spans(F.col("spans"))
    assert [(r["row_idx"], r["cells"]) for r in one(df, table.keyword_rows(t, ["date", "TOTAL 9"]))] == [(0, ["Due Date", "x"]), (2, ["total", "9"])]
    assert [r["row_idx"] for r in one(df, table.row_slice(t, 1, 5))] == [1, 2]
