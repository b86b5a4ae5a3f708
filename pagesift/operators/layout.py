"""Headings, paragraphs and tables from positioned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import let, utrim
from pagesift.operators import cluster
from pagesift.operators.table import table_from_spans
from pagesift.schema import ELEMENT, TABLE

HEADING, CANDIDATE, PARAGRAPH, TABLE_KIND = "heading", "table_candidate", "paragraph", "table"


def body_font_size(spans: Column) -> Column:
    """The half-point size with the most characters, the larger on a tie; 12 if none."""
    sized = F.transform(spans, lambda s: F.struct(F.round(s["font_size"] * 2).cast("int").alias("key"), F.length(s["text"]).alias("n")))

    def heaviest(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda r: r["key"]))
        total = lambda k: F.aggregate(F.filter(rows, lambda r: r["key"] == k), F.lit(0), lambda a, r: a + r["n"])
        return F.array_max(F.transform(keys, lambda k: F.struct(total(k).alias("n"), k.alias("key"))))["key"] / 2.0

    return F.when(F.size(spans) == 0, F.lit(12.0)).otherwise(let(sized, heaviest))


def classify_line(row: Column, body: Column) -> Column:
    """``struct<kind, level, y, text, clusters, spans>`` of one line."""

    def line(s: Column) -> Column:
        largest = F.aggregate(s, F.lit(0.0), lambda a, x: F.greatest(a, x["font_size"]))
        ratio = F.when(body > 0, largest / body).otherwise(F.lit(1.0))
        facts = F.struct(ratio.alias("ratio"), cluster.x_clusters(s).alias("n"))

        def judged(f: Column) -> Column:
            big = (f["ratio"] >= 1.3) & (f["n"] <= 2)
            level = F.when(big, F.when(f["ratio"] >= 1.8, 1).when(f["ratio"] >= 1.4, 2).otherwise(3)).otherwise(0)
            return F.struct(
                F.when(big, HEADING).when(f["n"] >= 3, CANDIDATE).otherwise(PARAGRAPH).alias("kind"),
                level.alias("level"),
                cluster.mean(F.transform(s, lambda x: x["y"])).alias("y"),
                F.array_join(F.transform(s, lambda x: utrim(x["text"])), " ").alias("text"),
                f["n"].alias("clusters"),
                s.alias("spans"),
            )

        return let(facts, judged)

    return let(cluster.by_x(row), line)


def classify_lines(spans: Column) -> Column:
    """Every line of a page, classified against the page's body size."""

    def page(kept: Column) -> Column:
        rows = cluster.cluster_rows(kept, cluster.row_tolerance(kept))
        return let(body_font_size(kept), lambda body: F.transform(rows, lambda r: classify_line(r, body)))

    return let(cluster.drop_blank(spans), lambda k: F.when(F.size(k) > 0, page(k)))


def line_runs(lines: Column, body: Column) -> Column:
    """Lines grouped into runs that make one element each: a heading a line, runs of
    candidates, paragraph lines up to a gap of over 1.5 body sizes."""

    def starts(line: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        gap = F.abs(before["y"] - line["y"]) > body * 1.5
        return F.when((i == 0) | (line["kind"] == HEADING) | (line["kind"] != before["kind"]) | ((line["kind"] == PARAGRAPH) & gap), i)

    return cluster.cut(lines, F.filter(F.transform(lines, starts), lambda i: i.isNotNull()))


def _is_table(run: Column) -> Column:
    return (run[0]["kind"] == CANDIDATE) & ((F.size(run) >= 2) | (run[0]["clusters"] >= 4))


def _element(run: Column, grid: Column) -> Column:
    def element(kind, level, text, table) -> Column:
        return F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), text.cast("string").alias("text"), table.cast(TABLE).alias("table")).cast(ELEMENT)

    none, zero, first = F.lit(None), F.lit(0), run[0]
    text = F.array_join(F.transform(run, lambda x: x["text"]), " ")
    return F.when(first["kind"] == HEADING, element(HEADING, first["level"], first["text"], none)).when(_is_table(run), element(TABLE_KIND, zero, none, grid)).otherwise(element(PARAGRAPH, zero, text, none))


def elements(spans: Column) -> Column:
    """The elements of a page as one expression, for use in SQL; :func:`classify_spans` does the
    same in columns of their own."""

    def made(runs: Column) -> Column:
        grid = lambda r: F.when(_is_table(r), table_from_spans(F.flatten(F.transform(r, lambda x: x["spans"]))))
        every = F.transform(runs, lambda r: _element(r, grid(r)))
        return F.filter(every, lambda e: (e["kind"] != PARAGRAPH) | (utrim(e["text"]) != ""))

    def lined(kept: Column, body: Column) -> Column:
        rows = F.transform(cluster.cluster_rows(kept, cluster.row_tolerance(kept)), lambda r: classify_line(r, body))
        return let(rows, lambda lines: let(line_runs(lines, body), made))

    return let(cluster.drop_blank(spans), lambda kept: let(body_font_size(kept), lambda body: lined(kept, body)))


def classify_spans(pages: DataFrame, spans: str = "spans", elements: str = "elements") -> DataFrame:
    """``pages`` with the page's elements added, in page order; a page without text has
    none. Each step is a column of its own, so no step is evaluated twice and
    expressions stay shallow; nothing shuffles."""
    kept, body, lines, runs, grids = (f"_{elements}_{x}" for x in ("kept", "body", "lines", "runs", "grids"))
    df = pages.withColumn(kept, cluster.drop_blank(F.col(spans)))
    df = df.withColumn(body, body_font_size(F.col(kept)))
    rows = cluster.cluster_rows(F.col(kept), cluster.row_tolerance(F.col(kept)))
    df = df.withColumn(lines, rows).withColumn(lines, F.transform(lines, lambda r: classify_line(r, F.col(body))))
    df = df.withColumn(runs, line_runs(F.col(lines), F.col(body)))
    table_spans = F.transform(runs, lambda r: F.when(_is_table(r), F.flatten(F.transform(r, lambda x: x["spans"]))))
    df = df.withColumn(grids, table_spans)
    df = df.withColumn(grids, F.transform(grids, lambda s: F.when(s.isNotNull(), table_from_spans(s))))
    made = F.zip_with(runs, grids, _element)
    df = df.withColumn(elements, F.filter(made, lambda e: (e["kind"] != PARAGRAPH) | (utrim(e["text"]) != "")))
    return df.drop(kept, body, lines, runs, grids)
