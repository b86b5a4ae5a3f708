"""Table grids from positioned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import let
from pagesift.operators import cluster
from pagesift.schema import TABLE


def _empty() -> Column:
    return F.struct(F.lit(0).alias("num_columns"), F.array().cast("array<array<string>>").alias("rows")).cast(TABLE)


def assign_columns(row: Column, columns: Column) -> Column:
    """One row's cells: texts of a column joined by a blank, in x order."""
    placed = F.transform(cluster.by_x(row), lambda s: F.struct(cluster.nearest_column(s["x"], columns).alias("at"), s["text"].alias("text")))
    return let(placed, lambda p: F.transform(columns, lambda c, j: F.array_join(F.transform(F.filter(p, lambda a: a["at"] == j), lambda a: a["text"]), " ")))


def table_from_spans(spans: Column) -> Column:
    """``struct<num_columns, rows>``; every row has ``num_columns`` cells."""

    def grid(kept: Column) -> Column:
        rows = cluster.cluster_rows(kept, cluster.row_tolerance(kept))
        columns = cluster.detect_columns(kept)
        cells = let(columns, lambda c: F.transform(rows, lambda r: assign_columns(r, c)))
        made = let(cells, lambda g: F.struct(F.size(g[0]).alias("num_columns"), g.alias("rows")).cast(TABLE))
        return F.when(F.size(kept) == 0, _empty()).otherwise(made)

    return let(cluster.drop_blank(spans), grid)


def numbered_rows(table: Column) -> Column:
    """``array<struct<row_idx, cells>>`` of a table."""
    return F.transform(table["rows"], lambda r, i: F.struct(i.alias("row_idx"), r.alias("cells")))


def keyword_rows(table: Column, words) -> Column:
    """The numbered rows whose joined, lower-cased text has one of ``words``."""

    def hit(row: Column) -> Column:
        line = F.lower(F.array_join(row["cells"], " "))
        out = F.lit(False)
        for w in words:
            out = out | F.contains(line, F.lit(w.lower()))
        return out

    return F.filter(numbered_rows(table), hit)


def row_slice(table: Column, first: int, last: int) -> Column:
    """The numbered rows ``first`` to ``last`` that aren't empty."""
    inside = lambda row: (row["row_idx"] >= first) & (row["row_idx"] <= last)
    return F.filter(numbered_rows(table), lambda row: inside(row) & F.exists(row["cells"], lambda c: c != ""))
