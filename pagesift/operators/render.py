"""Renderings of tables and elements, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import let, utrim_end
from pagesift.operators.layout import HEADING, TABLE_KIND


def _lines(rows: Column, one) -> Column:
    return F.array_join(F.transform(rows, one), "\n")


def csv_cell(c: Column) -> Column:
    """Quoted only if a comma, quote or line end occurs; quotes doubled."""
    return F.when(c.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def to_csv(table: Column) -> Column:
    return _lines(table["rows"], lambda r: F.array_join(F.transform(r, csv_cell), ","))


def to_tsv(table: Column) -> Column:
    return _lines(table["rows"], lambda r: F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("\t"), F.lit(" "))), "\t"))


def _widths(rows: Column, least: int) -> Column:
    """Longest cell of each column, in characters."""
    return F.transform(rows[0], lambda _, j: F.greatest(F.lit(least), F.array_max(F.transform(rows, lambda r: F.length(F.get(r, j))))))


def to_text(table: Column) -> Column:
    """Columns padded on the right, two blanks between, no blanks at line ends."""

    def page(rows: Column) -> Column:
        return let(_widths(rows, 0), lambda w: _lines(rows, lambda r: utrim_end(F.array_join(F.transform(r, lambda c, j: F.rpad(c, F.get(w, j), F.lit(" "))), "  "))))

    return let(table["rows"], lambda rows: F.when(F.size(rows) == 0, F.lit("")).otherwise(page(rows)))


def table_to_markdown(table: Column) -> Column:
    """A pipe table; the first row is the header, columns at least three wide."""
    bars = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def page(rows: Column) -> Column:
        def sized(w: Column) -> Column:
            body = F.transform(rows, lambda r: bars(F.transform(r, lambda c, j: F.rpad(c, F.get(w, j), F.lit(" ")))))
            rule = bars(F.transform(w, lambda n: F.repeat(F.lit("-"), n)))
            return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))), "\n")

        return let(_widths(rows, 3), sized)

    escaped = F.transform(table["rows"], lambda r: F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))))
    return let(escaped, lambda rows: F.when(F.size(rows) == 0, F.lit("")).otherwise(page(rows)))


def _page(parts: Column) -> Column:
    """Parts with a blank line between; ends in one line feed unless empty."""
    return let(utrim_end(F.array_join(parts, "\n\n")), lambda t: F.when(t == "", t).otherwise(F.concat(t, F.lit("\n"))))


def elements_to_txt(elements: Column) -> Column:
    return _page(F.transform(elements, lambda e: F.when(e["kind"] == TABLE_KIND, to_text(e["table"])).otherwise(e["text"])))


def elements_to_markdown(elements: Column) -> Column:
    return _page(
        F.transform(
            elements,
            lambda e: F.when(e["kind"] == HEADING, F.concat(F.repeat(F.lit("#"), e["level"]), F.lit(" "), e["text"])).when(e["kind"] == TABLE_KIND, table_to_markdown(e["table"])).otherwise(e["text"]),
        )
    )


def join_pages(bodies: Column) -> Column:
    """Page texts in page order: leading empty pages leave nothing, a later one a line
    feed."""
    return from_first(bodies, lambda b: b, lambda left: F.array_join(left, "\n"))


def from_first(pages: Column, body, joined) -> Column:
    """``joined`` of the pages from the first on whose ``body`` isn't empty, or ''."""
    at = F.array_position(F.transform(pages, lambda p: body(p) != ""), F.lit(True)).cast("int")
    return let(at, lambda k: F.when(k > 0, joined(F.slice(pages, F.greatest(k, F.lit(1)), F.greatest(F.size(pages), F.lit(1))))).otherwise(F.lit("")))
