"""Whole documents: pages of spans to CSV, TSV, aligned text, plain text, Markdown or a
span dump, and the command line."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators import layout, render
from pagesift.operators.table import table_from_spans
from pagesift.pdf.errors import TEXTS
from pagesift.sources import pdf
from pagesift.sources.workers import share_package

TABLES = {"csv": render.to_csv, "tsv": render.to_tsv, "text": render.to_text}
ELEMENTS = {"txt": render.elements_to_txt, "md": render.elements_to_markdown}
FORMATS = [*TABLES, *ELEMENTS, "raw"]


def page_bodies(pages: DataFrame, fmt: str = "csv") -> DataFrame:
    """``doc_id, page_no, body``; pages with an error are left out."""
    good = pages.where(F.col("error").isNull()) if "error" in pages.columns else pages
    good = good.where(F.col("page_no").isNotNull())
    return _with_bodies(good, fmt)


def _with_bodies(pages: DataFrame, fmt: str, *also: str) -> DataFrame:
    """``doc_id, page_no, body`` and what ``also`` names, of every row."""
    if fmt in TABLES:
        return pages.select("doc_id", "page_no", *also, TABLES[fmt](table_from_spans(F.col("spans"))).alias("body"))
    if fmt in ELEMENTS:
        return layout.classify_spans(pages).select("doc_id", "page_no", *also, ELEMENTS[fmt](F.col("elements")).alias("body"))
    if fmt != "raw":
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    share_package(pages.sparkSession)
    return pages.select("doc_id", "page_no", *also, raw_lines(F.col("spans")).alias("body"))


def raw_lines(spans: Column) -> Column:
    """``[x, y] (size pt): text`` a span. Exact rounding of doubles to a tenth is not what
    the JVM's formatting does, so the lines are made in Python."""
    @F.arrow_udf("string")
    def lines(pages: pa.Array) -> pa.Array:
        def one(s) -> str:
            return f"[{s['x']:.1f}, {s['y']:.1f}] ({s['font_size']:.15g}pt): {s['text']}\n"

        return pa.array(("".join(map(one, p.as_py() or ())) for p in pages), pa.string())

    return lines(spans)


def whole(bodies: DataFrame, raw: bool = False, compat: bool = False) -> DataFrame:
    """``doc_id, body``: a document's pages joined in order. This groups one document's
    text, the only shuffle of the engine, with partial lists before it. Pages of a raw dump
    are headed by their number, in ``compat`` by a pair of braces."""
    joined = bodies.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "body"))).alias("p"))
    if not raw:
        return joined.select("doc_id", render.join_pages(F.transform("p", lambda x: x["body"])).alias("body"))
    number = lambda x: F.lit("{}") if compat else (x["page_no"] + 1).cast("string")
    page = lambda x, i: F.when(i == 0, x["body"]).otherwise(F.concat(F.lit("\n--- Page "), number(x), F.lit(" ---\n"), x["body"]))
    return joined.select("doc_id", render.from_first(F.col("p"), lambda x: x["body"], lambda left: F.array_join(F.transform(left, page), "")).alias("body"))


def error_text(error: Column) -> Column:
    """An error as it reads: where it arose, then what it is."""
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{message}"), F.coalesce(error["message"], F.lit(""))), F.lit("{position}"), F.coalesce(error["position"].cast("string"), F.lit("")))
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for kind, text in TEXTS.items():
        out = out.when(error["class"] == kind, fill(text))
    return out.otherwise(error["class"])


def _strict(files: DataFrame, fmt: str, page_no: int | None = None, **reading) -> DataFrame:
    """``doc_id, body, error``: a file's rendering, or the first error in it as text."""
    pages = pdf.pages(files, page_no=page_no, **reading)
    number = F.coalesce(F.col("page_no"), F.lit(-1 if page_no is None else page_no))
    where = F.when(F.col("error.stage") == "parse", "Parse error: ").when(F.col("error.stage") == "pages", "Page count error: ").otherwise(F.concat(F.lit("Page "), (number + 1).cast("string"), F.lit(" error: ")))
    said = F.when(F.col("error").isNotNull(), F.struct(number.alias("n"), F.concat(where, error_text(F.col("error"))).alias("text")))
    # text and error of a page come from one reading of its file
    rows = _with_bodies(pages.withColumn("said", said), fmt, "said")
    page = F.when(F.col("said").isNull(), F.struct("page_no", "body"))
    joined = rows.groupBy("doc_id").agg(F.min("said").alias("said"), F.sort_array(F.collect_list(page)).alias("p"))
    body = render.join_pages(F.transform("p", lambda x: x["body"]))
    return joined.select("doc_id", F.when(F.col("said").isNull(), body).alias("body"), F.col("said.text").alias("error"))


def pdf_to_csv(files: DataFrame, **reading) -> DataFrame:
    """``doc_id, body, error`` of files (``path, content``), one row a distinct path: all
    pages as CSV, or the first error. Like the three below."""
    return _strict(files, "csv", **reading)


def pdf_to_tsv(files: DataFrame, **reading) -> DataFrame:
    return _strict(files, "tsv", **reading)


def pdf_to_txt(files: DataFrame, **reading) -> DataFrame:
    return _strict(files, "txt", **reading)


def pdf_to_md(files: DataFrame, **reading) -> DataFrame:
    return _strict(files, "md", **reading)


def pdf_page_to_csv(files: DataFrame, page_no: int, **reading) -> DataFrame:
    """The same of one page, counted from 0, of which alone the objects are read."""
    return _strict(files, "csv", page_no, **reading)


def pdf_page_count(files: DataFrame) -> DataFrame:
    """``doc_id, page_count, error``."""
    counts = page_counts(files)
    return counts.select("doc_id", "page_count", F.concat(F.when(F.col("error.stage") == "pages", "Page count error: ").otherwise("Parse error: "), error_text(F.col("error"))).alias("error"))


def documents(pages: DataFrame, fmt: str = "csv", raw_compat: bool = False) -> DataFrame:
    return whole(page_bodies(pages, fmt), raw=fmt == "raw", compat=raw_compat)


def documents_in(pages: DataFrame, formats: list[str]) -> DataFrame:
    """``format, doc_id, body``: each document in several table and element formats. Pages are read, and grids and
    elements made, once for all of them."""
    unknown = [f for f in formats if f not in TABLES and f not in ELEMENTS]
    if unknown:
        raise ValueError(f"unknown format {unknown[0]!r}; one of {', '.join([*TABLES, *ELEMENTS])}")
    good = pages.where(F.col("error").isNull()) if "error" in pages.columns else pages
    good = good.where(F.col("page_no").isNotNull()).select("doc_id", "page_no", "spans")
    if any(f in ELEMENTS for f in formats):
        good = layout.classify_spans(good)
    if any(f in TABLES for f in formats):
        good = good.withColumn("grid", table_from_spans(F.col("spans")))
    body = lambda f: TABLES[f](F.col("grid")) if f in TABLES else ELEMENTS[f](F.col("elements"))
    every = F.array(*[F.struct(F.lit(f).alias("format"), body(f).alias("body")) for f in formats])
    rows = good.select("doc_id", "page_no", F.explode(every).alias("e")).select("doc_id", "page_no", "e.*")
    joined = rows.groupBy("format", "doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "body"))).alias("p"))
    return joined.select("format", "doc_id", render.join_pages(F.transform("p", lambda x: x["body"])).alias("body"))


def page_counts(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """``doc_id, page_count, object_count, error``."""
    share_package(files.sparkSession)
    rows = files.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).alias("content"))
    return rows.lateralJoin(pdf.PdfInfo(F.col("content").outer())).select("doc_id", "page_count", "object_count", "error")


def table_elements(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, row_idx, col_idx, text``: the tables' cells as rows."""
    rows = pages.select("doc_id", "page_no", F.posexplode(table_from_spans(F.col("spans"))["rows"]).alias("row_idx", "r"))
    return rows.select("doc_id", "page_no", "row_idx", F.posexplode("r").alias("col_idx", "text"))


USAGE = """Usage: pagesift <pdf-file> [options]

Options:
  --csv, --tsv, --text   tables as CSV (default), TSV or aligned text
  --txt, --md            headings, paragraphs and tables as text or Markdown
  --raw                  positioned spans
  --page N               only page N, counted from 1
  -o FILE                write to FILE and not to standard output"""


def main(argv: list[str] | None = None) -> int:
    """``python -m pagesift FILE [--md] [--page N] [-o FILE]``: results to standard output or
    a file, progress and errors of pages to standard error. Unknown options are ignored, and
    a page that is no number means all."""
    args = sys.argv[1:] if argv is None else list(argv)
    if not args or args[0] in ("-h", "--help"):
        print(USAGE, file=sys.stderr)
        return 0 if args else 1
    name, fmt, page, output = args[0], "csv", None, None
    rest = iter(args[1:])
    for arg in rest:
        if arg.removeprefix("--") in FORMATS and arg.startswith("--"):
            fmt = arg[2:]
        elif arg in ("-f", "--format"):
            fmt = next((f for f in [next(rest, "")] if f in FORMATS), fmt)
        elif arg in ("-p", "--page"):
            given = next(rest, "")
            page = int(given) if given.isdigit() else None
        elif arg in ("-o", "--output"):
            output = next(rest, None)
    try:
        with open(name, "rb") as f:
            content = f.read()
    except OSError as e:
        print(f"cannot read {name}: {e}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    files = spark.createDataFrame([(name, bytearray(content))], "path string, content binary")
    found = pdf_page_count(files).first()
    if found["error"] and found["error"].startswith("Parse error"):
        print(found["error"], file=sys.stderr)
        return 1
    count = found["page_count"] or 0
    print(f"{name}: {count} pages", file=sys.stderr)
    if page is not None and not 1 <= page <= count:
        print(f"no page {page}: the document has {count}", file=sys.stderr)
        return 1
    # one file's pages are read once here, then rendered from memory
    pages = pdf.pages(files, page_no=None if page is None else page - 1)
    rows = pages.collect()
    for r in rows:
        if r["error"]:
            print(f"page {'-' if r['page_no'] is None else r['page_no'] + 1}: {r['error']['class']} {r['error']['message']}", file=sys.stderr)
    body = documents(spark.createDataFrame(rows, pages.schema), fmt).first()
    text = body["body"] if body else ""
    if output:
        try:
            with open(output, "w", encoding="utf-8") as f:
                f.write(text)
        except OSError as e:
            print(f"cannot write {output}: {e}", file=sys.stderr)
            return 1
    else:
        print(text)
    return 0
