"""Queries that start from file bytes, content streams or raw spans, with their SQL.

The files are written from span fixtures, so the SQL states what went in.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift import api
from pagesift.operators import content
from pagesift.operators import files as relations
from pagesift.operators.objects import view_name
from pagesift.plans import fixtures, pdf_writer
from pagesift.plans import oracles as O
from pagesift.sources import documents, pdf
from pagesift.sources.shared import scratch_folder
from pagesift.sources.workers import share_package

_P = "doc_id, page_no"
_DOCS = "spans_trimmed"


#: Bytes of files after which a batch of them is handed on, which bounds a task's memory.
BATCH_BYTES = 4_000_000


def _batch(paths: list, bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])


def _write_files(batches):
    """One document at a time becomes Python objects, which take several times its Arrow form."""
    ways, paths, bodies, size = len(pdf_writer.VARIANTS), [], [], 0
    for batch in batches:
        for doc, pages in zip(batch.column(0), batch.column(1), strict=True):
            doc, pages = doc.as_py(), pages.as_py()
            if not pages:
                continue
            paths.append(doc)
            bodies.append(pdf_writer.write([p["spans"] for p in pages], pdf_writer.VARIANTS[sum(doc.encode()) % ways]))
            size += len(bodies[-1])
            if size >= BATCH_BYTES:
                yield _batch(paths, bodies)
                paths, bodies, size = [], [], 0
        batch = pages = None  # not held while the next one is read
    if paths:
        yield _batch(paths, bodies)


def files(spark: SparkSession, sf: str, name: str = _DOCS) -> DataFrame:
    """``path, content``: one PDF file per document of a fixture, in all variants."""
    share_package(spark)
    return fixtures.documents(spark, sf, name).mapInArrow(_write_files, "path string, content binary")


def _flat(pages: DataFrame) -> DataFrame:
    # an inner explode gets a filter on size and null, pushed down with two more copies of what makes the spans
    return pages.select("doc_id", "page_no", F.explode_outer("spans").alias("s")).where("s is not null").select("doc_id", "page_no", F.col("s.ord").cast("long").alias("ord"), "s.text", F.round("s.x", 6).alias("x"), F.round("s.y", 6).alias("y"), F.col("s.font_size").alias("font_size"), "s.font_name")


def extract_page_text(spark, sf):
    return _flat(pdf.pages(files(spark, sf)))


def page_tree(spark, sf):
    return api.page_counts(files(spark, sf)).select("doc_id", "page_count")


def get_page(spark, sf):
    """The second page of each file, of which nothing else is read."""
    return _flat(pdf.pages(files(spark, sf), page_no=1, mode=pdf.DROPMALFORMED))


def _udtf(spark, df: DataFrame, call: str, keep: str) -> DataFrame:
    pdf.register(spark)
    return spark.sql(f"SELECT {keep}, t.* FROM {view_name(spark, df)}, LATERAL {call} t")


def pdf_xref(spark, sf):
    """The objects of each file, and how many of them lie in an object stream."""
    rows = _udtf(spark, files(spark, sf), "pdf_xref(content)", "path AS doc_id").where("in_use")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("compressed"), 1)).alias("n_compressed"))


def object_count(spark, sf):
    return api.page_counts(files(spark, sf)).select("doc_id", "object_count")


def pdf_objects(spark, sf):
    """Pages and streams among the objects of each file."""
    rows = _udtf(spark, files(spark, sf), "pdf_objects(content)", "path AS doc_id")
    return rows.groupBy("doc_id").agg(F.count(F.when(F.array_contains("keys", "Resources"), 1)).alias("pages"), F.count(F.when(F.col("kind") == "dict", 1)).alias("dicts"))


def pdf_fonts(spark, sf):
    rows = _udtf(spark, files(spark, sf), "pdf_fonts(content)", "path AS doc_id")
    return rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "name", "encoding", F.col("mapped").cast("long").alias("mapped"))


def _named(call, *args):
    return lambda spark, sf: call(files(spark, sf), *args).where("error is null").select("doc_id", "body")


def _bodies(fmt: str):
    return lambda spark, sf: api.documents(pdf.pages(files(spark, sf)), fmt)


def raw_dump(spark, sf):
    return api.documents(fixtures.pages(spark, sf, _DOCS), "raw")


def file_pages(spark, sf):
    """Spans of each file by joins of its objects."""
    return _flat(relations.read_pages(files(spark, sf)))


def file_objects(spark, sf):
    return relations.read_objects(files(spark, sf), contents="none")[0].groupBy("doc_id").agg(F.count("*").alias("object_count"))


def file_page_tree(spark, sf):
    known, roots = relations.read_objects(files(spark, sf), contents="none")
    return relations.page_objects(roots, known).groupBy("doc_id").agg(F.count("*").alias("page_count"))


def file_fonts(spark, sf):
    known, roots = relations.read_objects(files(spark, sf), contents="none")
    fonts = relations.page_fonts(relations.page_objects(roots, known), known).select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.explode("fonts").alias("name", "how"))
    mapped = F.size("how.cids").cast("long")
    return fonts.select("doc_id", "page_no", "name", F.when(mapped > 0, "map").otherwise("table").alias("encoding"), F.when(mapped > 0, mapped).alias("mapped"))


def format_switch(spark, sf):
    """Each document in every format."""
    return api.documents_in(fixtures.pages(spark, sf, _DOCS), ["csv", "tsv", "txt", "md"])


def _written(spark, sf) -> str:
    """A folder with a CSV file for each document, written by the sink."""
    documents.register(spark)
    folder = scratch_folder(spark, "documents")
    to = folder.removeprefix("file:") if folder.startswith("file:/") else folder
    api.documents(fixtures.pages(spark, sf, _DOCS), "csv").write.format("documents").mode("overwrite").options(path=to, extension="csv").save()
    return folder


def document_sink(spark, sf):
    """The files of the sink, read back."""
    files = pdf.scan_files(spark, _written(spark, sf), glob="*.csv")
    return files.select(_document(), F.decode("content", "UTF-8").alias("body"))


def scan_files(spark, sf):
    """Files of up to 2,000 bytes by their sizes, contents unread."""
    return pdf.scan_files(spark, _written(spark, sf), glob="*.csv", max_bytes=2000).select(_document(), "length")


def _document():
    return F.regexp_extract("path", r"([^/]*)-[0-9a-f]{10}\.csv$", 1).alias("doc_id")


def content_ops(spark, sf):
    """Every text operator once, on the texts of ``part``."""
    stream = (
        "q BT /F1 10 Tf 14 TL 50 ' || (700 - p_partkey % 7) || ' Td (' || p_type || ') Tj (end) Tj T* (second) Tj 5 -20 TD (' || p_name || ') Tj (quoted) '' "
        "1 2 (double) \" 1 0 0 1 30 40 Tm [(a) -100 (b) -300 (c)] TJ /F2 8 Tf <4869> Tj ET Q (after) Tj << /a (b) >> (dropped) Do"
    )
    rows = fixtures.table(spark, sf, "part").selectExpr("p_partkey", f"cast('{stream.replace(chr(39) * 2, chr(92) + chr(39))}' AS BINARY) AS content")
    out = rows.select("p_partkey", F.explode(content.content_spans(F.col("content"))).alias("s")).select("p_partkey", "s.*")
    return out.select("p_partkey", F.col("ord").cast("long").alias("ord"), "text", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "font_size", "font_name")


_TYPED, _NAMED = "length(p_type)", "length(p_name)"
_CONTENT_ROWS = [
    (0, "p_type", "50", "b", 10, "'F1'"),
    (1, "'end'", f"50 + 5 * {_TYPED}", "b", 10, "'F1'"),
    (2, "'second'", "50", "b - 14", 10, "'F1'"),
    (3, "p_name", "55", "b - 34", 10, "'F1'"),
    (4, "'quoted'", "55", "b - 54", 10, "'F1'"),
    (5, "'double'", "55", "b - 74", 10, "'F1'"),
    (6, "'ab'", "30", "40", 10, "'F1'"),
    (7, "'c'", "30 + 5 + 1 + 5 + 3", "40", 10, "'F1'"),
    (8, "'Hi'", "30 + 5 + 1 + 5 + 3 + 5", "40", 8, "'F2'"),
    (9, "'after'", "0", "0", 12, "NULL"),
]
_CONTENT_SQL = "WITH p AS (SELECT *, 700 - p_partkey % 7 AS b FROM part) " + " UNION ALL ".join(
    f"SELECT p_partkey, {i}::BIGINT AS ord, {t} AS text, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y, {s}::DOUBLE AS font_size, {f}::VARCHAR AS font_name FROM p" for i, t, x, y, s, f in _CONTENT_ROWS
)


def tokens(spark, sf):
    text = "concat('<< /Key', p_partkey % 10, ' (', p_name, ') ', p_partkey, ' 0 R >> % note')"
    rows = fixtures.table(spark, sf, "part").selectExpr("p_partkey", f"cast({text} AS BINARY) AS content")
    return _udtf(spark, rows, "pdf_tokens(content)", "p_partkey").select("p_partkey", F.col("ord").cast("long").alias("ord"), "kind", "value")


_TOKEN_SQL = " UNION ALL ".join(
    f"SELECT p_partkey, {i}::BIGINT AS ord, '{k}' AS kind, {v} AS value FROM part"
    for i, (k, v) in enumerate([("word", "'<<'"), ("name", "'Key' || (p_partkey % 10)"), ("string", "p_name"), ("int", "p_partkey::VARCHAR"), ("int", "'0'"), ("word", "'R'"), ("word", "'>>'")])
)


def _deflate(batches):
    import zlib

    for batch in batches:
        packed = [zlib.compress(n.encode()) for n in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["p_partkey", "packed"])


def flate_decode(spark, sf):
    share_package(spark)
    rows = fixtures.table(spark, sf, "part").select("p_partkey", "p_name").mapInArrow(_deflate, "p_partkey long, packed binary")
    return rows.select("p_partkey", F.decode(pdf.flate_decode()("packed"), "UTF-8").alias("text"))


def _predicted(parms: bytes, rows: bytes) -> bytes:
    """A page whose content is coded by a predictor."""
    import zlib

    data = zlib.compress(rows)
    b = pdf_writer._Builder(())
    root, tree, page, body = (b.add(b"") for _ in range(4))
    b.add(b"<< /Type /Catalog /Pages 2 0 R >>", root)
    b.add(b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", tree)
    b.add(b"<< /Type /Page /Contents 4 0 R >>", page)
    b.add(b"<< /Length %d /Filter /FlateDecode /DecodeParms << %s >> >>\nstream\n%s\nendstream" % (len(data), parms, data), body)
    out = bytearray(b"%PDF-1.4\n")
    pdf_writer._rows(out, b.bodies, root, 5, None)
    return bytes(out)


def _damaged(text: str = "text") -> dict[str, tuple[bytes, str]]:
    """Broken files of one span, with the class each has."""
    span = {"text": text, "x": 1.0, "y": 2.0, "font_size": 10.0, "font_name": "F1"}
    good, packed, boxed = (pdf_writer.write([[span]], v) for v in ((), ("flate",), ("stream",)))
    return {
        "array": (good.replace(b"/Kids [", b"/Kids [[ "), "Parse"),
        "contents": (good.replace(b"/Contents", b"/Nothings"), "InvalidStructure"),
        "deflate": (packed.replace(b"stream\nx", b"stream\ny"), "DecompressError"),
        "dictionary": (good[: good.rfind(b"trailer\n<<")] + b"trailer\n<< /Size 9 /Root 1 0 R\nstartxref\n%d\n%%%%EOF\n" % good.rfind(b"xref\n0 1"), "Parse"),
        "filter": (packed.replace(b"/FlateDecode", b"/OtherDecode"), "UnsupportedFilter"),
        "header": (b"x" + good, "MissingHeader"),
        "length": (good.replace(b"/Length ", b"/Length 99"), "Parse"),
        "member": (boxed.replace(b"/N 5", b"/N 1", 1), "InvalidStructure"),
        "name": (good.replace(b"/Contents", b"/Con#ffnts"), "InvalidUtf8"),
        "number": (good.replace(b"2 0 obj", b"9 0 obj"), "Parse"),
        "object": (good.replace(b"/Pages 2 0 R", b"/Pages 9 0 R"), "ObjectNotFound"),
        "predictor": (_predicted(b"/Predictor /Up", b""), "InvalidStructure"),
        "ranges": (boxed.replace(b"/W [1 4 2]", b"/W [1 4 2] /Index 3"), "InvalidStructure"),
        "root": (good.replace(b"/Root 1 0 R", b"/Root 1 0  "), "Parse"),
        "rootname": (good.replace(b"/Root 1 0 R", b"/Root /None"), "InvalidStructure"),
        "section": (good.replace(b"\n0 1\n", b"\nx 1\n"), "InvalidXref"),
        "startxref": (good.replace(b"startxref", b"startyref"), "MissingEof"),
        "string": (good.replace(b"/Type /Catalog", b"/Type (Catalog"), "Parse"),
        "trailer": (good.replace(b"trailer\n<<", b"trailer\n[ "), "Parse"),
        "widths": (boxed.replace(b"/W [1 4 2]", b"/W [1 4]  "), "InvalidStructure"),
    }


def _write_damaged(batches):
    for batch in batches:
        made = []
        for doc, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            damaged = _damaged(f"text {doc}")
            made.append(damaged[sorted(damaged)[of]][0])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])


def errors(spark, sf):
    """A broken file for each document, in all ways in turn."""
    share_package(spark)
    docs = fixtures.table(spark, sf, "documents").select(F.col("doc_id").cast("string"), (F.col("doc_id") % len(_damaged())).cast("int").alias("of"))
    rows = docs.mapInArrow(_write_damaged, "path string, content binary")
    return pdf.pages(rows).where("error is not null").select("doc_id", F.col("error.class").alias("class"))


def _write_predicted(batches):
    """Pages coded by differences (2) and by each row filter of PNG."""
    for batch in batches:
        made = []
        for name, key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
            plain = f"BT /F1 8 Tf 5 {key % 90} Td ({name}) Tj ET".encode()
            plain += b" " * (-len(plain) % 12)
            rows, filtered, above = [plain[i : i + 12] for i in range(0, len(plain), 12)], bytearray(), bytes(12)
            kind = key % 6
            for row in rows:
                left, corner = b"\0\0\0" + row[:-3], b"\0\0\0" + above[:-3]
                guess = [bytes(12), left, above, bytes((a + b) // 2 for a, b in zip(left, above, strict=True)), bytes(min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left, above, corner, strict=True)), left][kind]  # noqa: B023
                filtered += (b"" if kind == 5 else bytes([kind])) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
                above = row
            made.append(_predicted(b"/Predictor %d /Colors 3 /Columns 4" % (2 if kind == 5 else 10 + kind), bytes(filtered)))
        yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in batch.column(0).to_pylist()]), pa.array(made, pa.binary())], ["path", "content"])


def predictors(spark, sf):
    share_package(spark)
    rows = fixtures.table(spark, sf, "part").select("p_partkey", "p_name").mapInArrow(_write_predicted, "path string, content binary")
    return _flat(pdf.pages(rows)).select("doc_id", "text", "y")


QUERIES = {
    "extract_page_text": extract_page_text,
    "get_page": get_page,
    "page_tree": page_tree,
    "pdf_xref": pdf_xref,
    "object_count": object_count,
    "pdf_objects": pdf_objects,
    "pdf_fonts": pdf_fonts,
    "pdf_to_tsv": _named(api.pdf_to_tsv),
    "pdf_page_to_csv": _named(api.pdf_page_to_csv, 1),
    "pdf_page_count": lambda spark, sf: api.pdf_page_count(files(spark, sf)).select("doc_id", "page_count"),
    "predictors": predictors,
    "bytes_to_txt": _bodies("txt"),
    "bytes_to_markdown": _bodies("md"),
    "bytes_to_csv": _bodies("csv"),
    "raw_dump": raw_dump,
    "file_pages": file_pages,
    "file_objects": file_objects,
    "file_page_tree": file_page_tree,
    "file_fonts": file_fonts,
    "format_switch": format_switch,
    "document_sink": document_sink,
    "scan_files": scan_files,
    "content_ops": content_ops,
    "pdf_tokens": tokens,
    "flate_decode": flate_decode,
    "pdf_errors": errors,
}

_OUT = "doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ord) - 1 AS ord, text, round(x, 6) AS x, round(y, 6) AS y, font_size, font_name"
_FULL = "SELECT doc_id, string_agg(body, chr(10) ORDER BY page_no) AS body FROM pages_t GROUP BY doc_id"


_TENTH = lambda c: f"printf('%.1f', {c})"

_WAY = f"list_sum(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))) % {len(pdf_writer.VARIANTS)}"
_CMAP = next(i for i, v in enumerate(pdf_writer.VARIANTS) if "cmap" in v)


def _counted(what: str) -> str:
    """Facts of each file by what its variant writes: catalog, tree, font and resources, a
    page and its streams, and what the variant adds."""
    ways = lambda name: f"way IN ({', '.join(str(i) for i, v in enumerate(pdf_writer.VARIANTS) if name in v)})"
    return (
        O.with_(O.spans(_DOCS))
        + f""", pages_of AS (SELECT doc_id, page_no, {_WAY} AS way, count(*) AS k FROM spans GROUP BY doc_id, page_no),
docs AS (SELECT doc_id, count(*) AS p, {ways("stream")} AS boxed, {ways("tree")} AS tree, 4 + count(*) + CASE WHEN {ways("cmap")} THEN 1 ELSE 0 END
  + sum(CASE WHEN {ways("parts")} AND k > 1 THEN 2 ELSE 1 END) * CASE WHEN {ways("length")} THEN 2 ELSE 1 END
  + CASE WHEN {ways("tree")} THEN (count(*) + 1) // 2 ELSE 0 END + CASE WHEN {ways("stream")} THEN 2 ELSE 0 END AS n FROM pages_of GROUP BY doc_id, way)
SELECT {what} FROM docs"""
    )


def _sheets(cell: str, sep: str) -> str:
    return O.table_rows(_DOCS) + f", l AS (SELECT {_P}, row_idx, string_agg({cell}, {sep} ORDER BY col_idx) AS line FROM tcells GROUP BY {_P}, row_idx), pages_t AS (SELECT {_P}, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM l GROUP BY {_P}) {_FULL}"


_CSV, _TSV = _sheets(O.CSV_CELL, "','"), _sheets("replace(text, chr(9), ' ')", "chr(9)")
_TXT, _MD = (O.with_(*O.elements(_DOCS)) + f", pages_t AS (SELECT {_P}, {c} AS body FROM pages_out) {_FULL}" for c in ("txt", "md"))

ORACLES = {
    "format_switch": " UNION ALL ".join(f"SELECT '{n}' AS format, * FROM ({q})" for n, q in {"csv": _CSV, "tsv": _TSV, "txt": _TXT, "md": _MD}.items()),
    "document_sink": _CSV,
    "scan_files": f"SELECT doc_id, octet_length(encode(body))::BIGINT AS length FROM ({_CSV}) WHERE octet_length(encode(body)) <= 2000",
    "extract_page_text": O.with_(O.spans(_DOCS)) + f"SELECT {_OUT} FROM spans",
    "get_page": O.with_(O.spans(_DOCS)) + f"SELECT {_OUT} FROM spans WHERE page_no = 1",
    "pdf_xref": _counted("doc_id, n, CASE WHEN boxed THEN 4 + p ELSE 0 END AS n_compressed"),
    "object_count": _counted("doc_id, n AS object_count"),
    "pdf_objects": _counted("doc_id, p AS pages, 4 + p + CASE WHEN tree THEN (p + 1) // 2 ELSE 0 END AS dicts"),
    "pdf_fonts": O.with_(O.spans(_DOCS)) + f"SELECT {_P}::BIGINT AS page_no, 'F1' AS name, CASE WHEN {_WAY} = {_CMAP} THEN 'map' ELSE 'table' END AS encoding, CASE WHEN {_WAY} = {_CMAP} THEN 224::BIGINT END AS mapped FROM spans GROUP BY {_P}",
    "pdf_to_tsv": O.table_rows(_DOCS) + f", l AS (SELECT {_P}, row_idx, string_agg(replace(text, chr(9), ' '), chr(9) ORDER BY col_idx) AS line FROM tcells GROUP BY {_P}, row_idx), pages_t AS (SELECT {_P}, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM l GROUP BY {_P}) {_FULL}",
    "pdf_page_to_csv": O.table_rows(_DOCS) + f", l AS (SELECT {_P}, row_idx, string_agg({O.CSV_CELL}, ',' ORDER BY col_idx) AS line FROM tcells WHERE page_no = 1 GROUP BY {_P}, row_idx) SELECT doc_id, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM l GROUP BY doc_id",
    "pdf_page_count": O.with_(O.spans(_DOCS)) + "SELECT doc_id, count(DISTINCT page_no) AS page_count FROM spans GROUP BY doc_id",
    "predictors": "SELECT p_partkey::VARCHAR AS doc_id, p_name AS text, (p_partkey % 90)::DOUBLE AS y FROM part",
    "page_tree": O.with_(O.spans(_DOCS)) + "SELECT doc_id, count(DISTINCT page_no) AS page_count FROM spans GROUP BY doc_id",
    "bytes_to_txt": O.with_(*O.elements(_DOCS)) + f", pages_t AS (SELECT {_P}, txt AS body FROM pages_out) {_FULL}",
    "bytes_to_markdown": O.with_(*O.elements(_DOCS)) + f", pages_t AS (SELECT {_P}, md AS body FROM pages_out) {_FULL}",
    "bytes_to_csv": O.table_rows(_DOCS) + f", l AS (SELECT {_P}, row_idx, string_agg({O.CSV_CELL}, ',' ORDER BY col_idx) AS line FROM tcells GROUP BY {_P}, row_idx), pages_t AS (SELECT {_P}, string_agg(line, chr(10) ORDER BY row_idx) AS body FROM l GROUP BY {_P}) {_FULL}",
    "raw_dump": O.with_(O.spans(_DOCS))
    + f""", p AS (SELECT {_P}, string_agg('[' || {_TENTH('x')} || ', ' || {_TENTH('y')} || '] (' || font_size::INT || 'pt): ' || text || chr(10), '' ORDER BY ord) AS body FROM spans GROUP BY {_P})
SELECT doc_id, string_agg(CASE WHEN page_no = 0 THEN '' ELSE chr(10) || '--- Page ' || (page_no + 1) || ' ---' || chr(10) END || body, '' ORDER BY page_no) AS body FROM p GROUP BY doc_id""",
    "content_ops": _CONTENT_SQL,
    "pdf_tokens": _TOKEN_SQL,
    "flate_decode": "SELECT p_partkey, p_name AS text FROM part",
    "pdf_errors": f"SELECT doc_id::VARCHAR AS doc_id, ([{', '.join(repr(c) for _, (_, c) in sorted(_damaged().items()))}])[doc_id % {len(_damaged())} + 1] AS class FROM documents",
}
ORACLES |= {
    "file_pages": ORACLES["extract_page_text"],
    "file_objects": ORACLES["object_count"],
    "file_page_tree": ORACLES["page_tree"],
    "file_fonts": ORACLES["pdf_fonts"],
}
