"""Every query of the layout engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions import text as T
from pagesift.functions.csv import csv_rows, format_size, row_count
from pagesift.operators import cluster, layout, render, table
from pagesift.operators.table import table_from_spans
from pagesift.plans import fixtures, pdf_queries, relational
from pagesift.plans import oracles as O

Query = Callable[[SparkSession, str], DataFrame]


def _pages(name: str, **columns: Callable[[Column], Column]) -> Query:
    """A query over a fixture's pages: ``doc_id, page_no`` and the given columns of
    ``spans``. Columns are made when the query runs, as they need a session."""
    return lambda spark, sf: fixtures.pages(spark, sf, name).select("doc_id", "page_no", *[c(F.col("spans")).alias(n) for n, c in columns.items()])


def _long(c: Column) -> Column:
    return c.cast("long")


def _rows_of(df: DataFrame, rows: Column, *out: Column) -> DataFrame:
    return df.select("doc_id", "page_no", F.posexplode(rows).alias("i", "r")).select("doc_id", "page_no", _long(F.col("i")).alias("row_idx"), *out)


def _grid(spark, sf, name="spans_lineitem") -> DataFrame:
    S = F.col("spans")
    return fixtures.pages(spark, sf, name).select("doc_id", "page_no", table_from_spans(S).alias("t"))


def cluster_rows(spark, sf):
    S = F.col("spans")
    kept = cluster.drop_blank(S)
    df = fixtures.pages(spark, sf, "spans_lineitem").select("doc_id", "page_no", kept.alias("spans"))
    r = F.col("r")
    return _rows_of(df, cluster.cluster_rows(S, cluster.row_tolerance(S)), _long(F.size(r)).alias("n_spans"), cluster.by_x(r)[0]["text"].alias("first_text"))


def cluster_lines(spark, sf):
    S = F.col("spans")
    df = fixtures.pages(spark, sf, "spans_statement").select("doc_id", "page_no", cluster.drop_blank(S).alias("spans"))
    line = F.array_join(F.transform(cluster.by_x(F.col("r")), lambda s: T.utrim(s["text"])), " ")
    return _rows_of(df, cluster.cluster_rows(S, cluster.row_tolerance(S)), line.alias("text"))


def x_clusters(spark, sf):
    S = F.col("spans")
    df = fixtures.pages(spark, sf, "spans_lineitem")
    return _rows_of(df, cluster.cluster_rows(S, cluster.row_tolerance(S)), _long(cluster.x_clusters(F.col("r"))).alias("n"))


def detect_columns(spark, sf):
    S = F.col("spans")
    df = fixtures.pages(spark, sf, "spans_lineitem").select("doc_id", "page_no", F.posexplode(cluster.detect_columns(S)).alias("i", "x"))
    return df.select("doc_id", "page_no", _long(F.col("i")).alias("col_idx"), F.round("x", 6).alias("x"))


def cells(spark, sf, name="spans_lineitem"):
    # outer: an inner explode infers a filter that would repeat the whole grid
    rows = _grid(spark, sf, name).select("doc_id", "page_no", F.posexplode_outer("t.rows").alias("row", "r")).where("row is not null")
    out = rows.select("doc_id", "page_no", "row", F.posexplode("r").alias("col", "text"))
    return out.select("doc_id", "page_no", _long(F.col("row")).alias("row_idx"), _long(F.col("col")).alias("col_idx"), "text")


def assign_columns(spark, sf):
    return cells(spark, sf).where("text <> ''")


def table_shape(spark, sf):
    return _grid(spark, sf).select("doc_id", "page_no", _long(F.col("t.num_columns")).alias("num_columns"), _long(F.size("t.rows")).alias("n_rows"))


def _lines(spark, sf, name):
    S = F.col("spans")
    return fixtures.pages(spark, sf, name).select("doc_id", "page_no", F.posexplode(layout.classify_lines(S)).alias("i", "e"))


def classify_line(spark, sf):
    return _lines(spark, sf, "spans_statement").select("doc_id", "page_no", _long(F.col("i")).alias("line_idx"), "e.kind", _long(F.col("e.level")).alias("level"), "e.text")


def _elements(name: str) -> Query:
    def run(spark, sf):
        df = layout.classify_spans(fixtures.pages(spark, sf, name)).select("doc_id", "page_no", F.posexplode_outer("elements").alias("i", "e"))
        # outer: an inner explode infers a filter that would repeat the whole expression
        df = df.where("i is not null")
        return df.select("doc_id", "page_no", _long(F.col("i")).alias("el_idx"), "e.kind", _long(F.col("e.level")).alias("level"), "e.text")

    return run


def _numbered(df: DataFrame, rows: Column) -> DataFrame:
    """Rows of tables with their number and their cells that aren't empty."""
    shown = F.array_join(F.filter("r.cells", lambda c: c != ""), " / ")
    return df.select("doc_id", "page_no", F.explode(rows).alias("r")).select("doc_id", "page_no", _long(F.col("r.row_idx")).alias("row_idx"), shown.alias("text"))


def keyword_rows(spark, sf, words=("|x",), name="spans_statement"):
    return _numbered(_grid(spark, sf, name), table.keyword_rows(F.col("t"), words))


def row_slice(spark, sf):
    return _numbered(_grid(spark, sf, "spans_statement"), table.row_slice(F.col("t"), 8, 19))


def page_count(spark, sf):
    return fixtures.pages(spark, sf, "spans_documents").groupBy("doc_id").agg(F.count("*").alias("n"))


def page_filter(spark, sf):
    """The second page of each document (pages are numbered from 0)."""
    return fixtures.pages(spark, sf, "spans_documents").where("page_no = 1").select("doc_id", _long(F.size("spans")).alias("n"))


def _rendered(name: str, body: Callable[[Column], Column]) -> Query:
    """A rendering of the elements of each page."""
    return lambda spark, sf: layout.classify_spans(fixtures.pages(spark, sf, name)).select("doc_id", "page_no", body(F.col("elements")).alias("body"))


def _whole(page: Query) -> Query:
    """One text per document: pages joined in page order."""

    def run(spark, sf):
        df = page(spark, sf)
        df = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "body"))).alias("p"))
        return df.select("doc_id", render.join_pages(F.transform("p", lambda x: x["body"])).alias("body"))

    return run


def _part_bytes(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_name").alias("name"))


def enc_winansi(spark, sf):
    """Documents have no character over U+00FF, so their Latin-1 bytes are a test text;
    codes 128 to 159 are appended."""
    b = F.concat(F.encode("text", "ISO-8859-1"), F.unhex(F.lit("".join(f"{c:02X}" for c in range(128, 160)))))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.winansi(b).alias("text"))


def enc_macroman(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.macroman(F.encode("text", "ISO-8859-1")).alias("text"))


def decode_default(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.decode_default(F.encode("text", "ISO-8859-1")).alias("text"))


def enc_identity(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.latin1(F.encode("text", "ISO-8859-1")).alias("text"))


def ascii_hex_decode(spark, sf):
    hexed = F.concat(F.regexp_replace(F.hex(F.encode("name", "UTF-8")), "(.{4})", "$1 "), F.lit(">rest"))
    return _part_bytes(spark, sf).select("p_partkey", F.decode(T.ascii_hex_decode(hexed), "UTF-8").alias("text"))


#: Two character maps for text whose codes are ASCII less 29: ranges and an array.
CMAP = """1 begincodespacerange <0000> <FFFF> endcodespacerange
1 beginbfchar <0003> <0020> endbfchar
2 beginbfrange
<0004> <0043> <0021>
<0044> <005D> [""" + " ".join(f"<{c:04X}>" for c in range(0x61, 0x7B)) + """]
endbfrange"""


def decode_bytes(spark, sf):
    codes = F.transform(F.split("name", ""), lambda c: F.lpad(F.hex(F.ascii(c) - 29), 4, "0"))
    cids = T.parse_tounicode(F.lit(CMAP))
    return _part_bytes(spark, sf).select("p_partkey", T.decode_bytes(F.unhex(F.array_join(codes, "")), cids).alias("text"))


def parse_tounicode(spark, sf):
    """A character map of one character and a range for each part."""
    k = F.col("p_partkey") % 500 + 4
    cmap = F.format_string("1 beginbfchar <0003> <0020> endbfchar 1 beginbfrange <%04X> <%04X> <0061> endbfrange", k, k + 25)
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.explode(T.parse_tounicode(cmap)).alias("cid", "letter"))
    return rows.select("p_partkey", _long(F.col("cid")).alias("cid"), "letter")


def parse_csv_rows(spark, sf):
    """CSV text back to cells."""
    rows = _grid(spark, sf).select("doc_id", "page_no", F.posexplode(csv_rows(render.to_csv(F.col("t")))).alias("i", "cells"))
    return rows.select("doc_id", "page_no", _long(F.col("i")).alias("row_idx"), F.array_join("cells", " / ").alias("text"))


def csv_row_count(spark, sf):
    return _grid(spark, sf).select("doc_id", "page_no", _long(row_count(render.to_csv(F.col("t")))).alias("n"))


def sizes(spark, sf):
    """Sizes of all magnitudes, from the prices of orders."""
    size = _long(F.round(F.col("o_totalprice") * 100)) % F.element_at(F.array(F.lit(900), F.lit(1_000_000), F.lit(10_000_000_000)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", format_size(size).alias("size"))


QUERIES: dict[str, Query] = {
    "drop_blank": _pages("spans_chars", n_all=lambda s: _long(F.size(s)), n_kept=lambda s: _long(F.size(cluster.drop_blank(s)))),
    "row_tolerance": _pages("spans_documents", tol=lambda s: F.round(cluster.row_tolerance(s), 6)),
    "cluster_rows": cluster_rows,
    "cluster_lines": cluster_lines,
    "x_clusters": x_clusters,
    "detect_columns": detect_columns,
    "assign_columns": assign_columns,
    "cells": cells,
    "table_from_spans": table_shape,
    "to_csv": _pages("spans_lineitem", body=lambda s: render.to_csv(table_from_spans(s))),
    "to_tsv": _pages("spans_lineitem", body=lambda s: render.to_tsv(table_from_spans(s))),
    "to_text": _pages("spans_lineitem", body=lambda s: render.to_text(table_from_spans(s))),
    "body_font_size": _pages("spans_documents", size=lambda s: layout.body_font_size(cluster.drop_blank(s))),
    "classify_line": classify_line,
    "merge_lines": _elements("spans_documents"),
    "classify_spans": _elements("spans_statement"),
    "elements_to_txt": _rendered("spans_statement", render.elements_to_txt),
    "elements_to_markdown": _rendered("spans_statement", render.elements_to_markdown),
    "page_text_lines": _pages("spans_documents", body=lambda s: cluster.page_text(s)),
    "keyword_rows": keyword_rows,
    "row_slice": row_slice,
    "page_count": page_count,
    "page_filter": page_filter,
    "pdf_to_text": _whole(_rendered("spans_documents", render.elements_to_txt)),
    "pdf_to_markdown": _whole(_rendered("spans_documents", render.elements_to_markdown)),
    "pdf_to_csv": _whole(_pages("spans_documents", body=lambda s: render.to_csv(table_from_spans(s)))),
    "enc_identity": enc_identity,
    "enc_winansi": enc_winansi,
    "enc_macroman": enc_macroman,
    "decode_default": decode_default,
    "ascii_hex_decode": ascii_hex_decode,
    "parse_tounicode": parse_tounicode,
    "decode_bytes": decode_bytes,
    "parse_csv_rows": parse_csv_rows,
    "row_count": csv_row_count,
    "format_size": sizes,
}

_P = "doc_id, page_no"
_LI = "spans_lineitem"


def _sheet(cell: str, sep: str, name: str = _LI) -> str:
    return O.table_rows(name) + f", l AS (SELECT {_P}, row_idx, string_agg({cell}, {sep} ORDER BY col_idx) AS line FROM tcells GROUP BY {_P}, row_idx) SELECT {_P}, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM l GROUP BY {_P}"


def _chars(pairs: tuple[str, str]) -> str:
    """Nested character replacement through a two-column list."""
    quote = lambda s: s.replace("'", "''")
    return f"translate(text, '{quote(pairs[0])}', '{quote(pairs[1])}')"


_HIGH = "".join(map(chr, range(128, 160)))
_SHOWN = "string_agg(text, ' / ' ORDER BY col_idx) FILTER (text <> '')"
_FULL = f"SELECT doc_id, string_agg(body, chr(10) ORDER BY page_no) AS body FROM pages_t GROUP BY doc_id"

ORACLES: dict[str, str] = {
    "drop_blank": O.with_(O.spans("spans_chars")) + f"SELECT {_P}, count(*) AS n_all, count(*) FILTER ({O.trim('text')} <> '') AS n_kept FROM spans GROUP BY {_P}",
    "row_tolerance": O.with_(O.spans("spans_documents")) + f"SELECT {_P}, round(avg(font_size) * 0.5, 6) AS tol FROM spans GROUP BY {_P}",
    "cluster_rows": O.with_(O.spans(_LI), O.rows("t", "kept", _P)) + f"SELECT {_P}, row_idx, count(*) AS n_spans, arg_min(text, pos) AS first_text FROM trows GROUP BY {_P}, row_idx",
    "cluster_lines": O.with_(O.spans("spans_statement"), O.rows("t", "kept", _P)) + f"SELECT {_P}, row_idx, string_agg({O.trim('text')}, ' ' ORDER BY pos) AS text FROM trows GROUP BY {_P}, row_idx",
    "x_clusters": O.with_(O.spans(_LI), O.rows("t", "spans", _P), O.clusters("x", "trows", _P)) + f"SELECT {_P}, row_idx, clusters AS n FROM xnx",
    "detect_columns": O.with_(O.spans(_LI), O.columns("c", "spans", _P)) + f"SELECT {_P}, col_idx, round(cx, 6) AS x FROM ccols",
    "assign_columns": O.table_rows(_LI) + f"SELECT {_P}, row_idx, col_idx, text FROM tfull",
    "cells": O.table_rows(_LI) + f"SELECT {_P}, row_idx, col_idx, text FROM tcells",
    "table_from_spans": O.table_rows(_LI) + f"SELECT {_P}, max(col_idx) + 1 AS num_columns, max(row_idx) + 1 AS n_rows FROM tcells GROUP BY {_P}",
    "to_csv": _sheet(O.CSV_CELL, "','"),
    "to_tsv": _sheet("replace(text, chr(9), ' ')", "chr(9)"),
    "to_text": O.with_(O.spans(_LI), O.rows("t", "kept", _P), O.grid("t", "trows", _P), O.table_text("t", _P)) + f"SELECT {_P}, body FROM ttext",
    "body_font_size": O.with_(O.spans("spans_documents"), O.BODY) + f"SELECT {_P}, size FROM body",
    "classify_line": O.with_(*O.classified("spans_statement")) + f"SELECT {_P}, row_idx AS line_idx, kind, level, text FROM kinds",
    "merge_lines": O.with_(*O.elements("spans_documents")) + f"SELECT {_P}, el_idx, kind, level, text FROM elems",
    "classify_spans": O.with_(*O.elements("spans_statement")) + f"SELECT {_P}, el_idx, kind, level, text FROM elems",
    "elements_to_txt": O.with_(*O.elements("spans_statement")) + f"SELECT {_P}, txt AS body FROM pages_out",
    "elements_to_markdown": O.with_(*O.elements("spans_statement")) + f"SELECT {_P}, md AS body FROM pages_out",
    "page_text_lines": O.with_(O.spans("spans_documents"), O.rows("t", "spans", _P, "3.0")) + f", l AS (SELECT {_P}, row_idx, string_agg(text, ' ' ORDER BY idx) AS line FROM trows GROUP BY {_P}, row_idx) SELECT {_P}, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM l GROUP BY {_P}",
    "keyword_rows": O.table_rows("spans_statement") + f"SELECT {_P}, row_idx, {_SHOWN} AS text FROM tcells GROUP BY {_P}, row_idx HAVING contains(lower(string_agg(text, ' ' ORDER BY col_idx)), '|x')",
    "row_slice": O.table_rows("spans_statement") + f"SELECT {_P}, row_idx, {_SHOWN} AS text FROM tcells WHERE row_idx BETWEEN 8 AND 19 GROUP BY {_P}, row_idx",
    "page_count": O.with_(O.spans("spans_documents")) + "SELECT doc_id, count(DISTINCT page_no) AS n FROM spans GROUP BY doc_id",
    "page_filter": O.with_(O.spans("spans_documents")) + "SELECT doc_id, count(*) AS n FROM spans WHERE page_no = 1 GROUP BY doc_id",
    "pdf_to_text": O.with_(*O.elements("spans_documents")) + f", pages_t AS (SELECT {_P}, txt AS body FROM pages_out) {_FULL}",
    "pdf_to_markdown": O.with_(*O.elements("spans_documents")) + f", pages_t AS (SELECT {_P}, md AS body FROM pages_out) {_FULL}",
    "pdf_to_csv": O.table_rows("spans_documents") + f", l AS (SELECT {_P}, row_idx, string_agg({O.CSV_CELL}, ',' ORDER BY col_idx) AS line FROM tcells GROUP BY {_P}, row_idx), pages_t AS (SELECT {_P}, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM l GROUP BY {_P}) {_FULL}",
    "enc_identity": "SELECT doc_id, text FROM documents",
    "enc_winansi": f"SELECT doc_id, {_chars(T.WINANSI)} AS text FROM (SELECT doc_id, text || '{_HIGH}' AS text FROM documents)",
    "enc_macroman": f"SELECT doc_id, {_chars(T.MACROMAN)} AS text FROM documents",
    "decode_default": r"SELECT doc_id, regexp_replace(text, '[^\x20-\x7e\x{a0}-\x{ff}]', ' ', 'g') AS text FROM documents",
    "ascii_hex_decode": "SELECT p_partkey, p_name AS text FROM part",
    "parse_tounicode": "SELECT p_partkey, 3::BIGINT AS cid, ' ' AS letter FROM part UNION ALL SELECT p_partkey, (p_partkey % 500 + 4 + i)::BIGINT, chr((97 + i)::INT) FROM part, range(26) r(i)",
    "decode_bytes": "SELECT p_partkey, p_name AS text FROM part",
    "parse_csv_rows": O.table_rows(_LI) + f"SELECT {_P}, row_idx, string_agg(text, ' / ' ORDER BY col_idx) AS text FROM tcells GROUP BY {_P}, row_idx HAVING bool_or(text <> '')",
    "row_count": O.table_rows(_LI) + f", r AS (SELECT {_P}, row_idx FROM tcells GROUP BY {_P}, row_idx HAVING bool_or(text <> '')) SELECT {_P}, count(*) - 1 AS n FROM r GROUP BY {_P}",
    "format_size": "SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor(b * 10 / 1048576.0 + 0.5) / 10) END AS size "
    "FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT % CASE o_orderkey % 3 WHEN 0 THEN 900 WHEN 1 THEN 1000000 ELSE 10000000000 END AS b FROM orders)",
}


def queries() -> dict[str, Query]:
    return QUERIES | pdf_queries.QUERIES | relational.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | pdf_queries.ORACLES | relational.ORACLES
