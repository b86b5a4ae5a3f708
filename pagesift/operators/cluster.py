"""Clustering of positioned text within a page, as array expressions.

A page is one row with an array of spans, so nothing here shuffles. Two rules that
differ on purpose: rows, lines and x clusters compare with the *first* value of the
cluster (anchored), columns with the *previous* one (chained).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import WHITE, let

X_TOLERANCE = 10.0


def drop_blank(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["text"].rlike(rf"[^{WHITE}]"))


def mean(values: Column) -> Column:
    """Mean in array order, so a result that feeds a comparison never depends on
    how rows were distributed; null for an empty array."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def row_tolerance(spans: Column) -> Column:
    return mean(F.transform(spans, lambda s: s["font_size"])) * 0.5


def reading_order(spans: Column) -> Column:
    """Top to bottom, then left to right, then emission order."""
    keyed = F.transform(spans, lambda s: F.struct((-s["y"]).alias("down"), s["x"].alias("x"), s["ord"].alias("ord"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def by_x(row: Column) -> Column:
    keyed = F.transform(row, lambda s, i: F.struct(s["x"].alias("x"), i.alias("i"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def anchored_starts(values: Column, tolerance: Column) -> Column:
    """Where a new cluster starts in an array of doubles: one append a cluster."""
    none = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"))

    def step(acc: Column, v: Column) -> Column:
        same = acc["at"].isNotNull() & (F.abs(v - acc["at"]) <= tolerance)
        return F.struct(F.when(same, acc["at"]).otherwise(v).alias("at"), F.when(same, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"), (acc["i"] + 1).alias("i"))

    return F.aggregate(values, none, step, lambda acc: acc["starts"])


def chained_starts(values: Column, tolerance: float) -> Column:
    """Where a value is more than ``tolerance`` from the one before it."""
    new = F.transform(values, lambda v, i: F.when((i == 0) | (F.abs(v - F.get(values, i - 1)) > tolerance), i))
    return F.filter(new, lambda i: i.isNotNull())


def cut(values: Column, starts: Column) -> Column:
    """An array cut at ``starts`` into an array of arrays."""
    return F.transform(starts, lambda s, k: F.slice(values, s + 1, F.coalesce(F.get(starts, k + 1), F.size(values)) - s))


def cluster_rows(spans: Column, tolerance: Column) -> Column:
    """Spans of each row, rows from the top, spans in reading order."""
    return let(reading_order(spans), lambda s: let(tolerance, lambda t: let(anchored_starts(F.transform(s, lambda x: x["y"]), t), lambda at: cut(s, at))))


def x_clusters(row: Column) -> Column:
    xs = F.sort_array(F.transform(row, lambda s: s["x"]))
    return F.size(anchored_starts(xs, F.lit(X_TOLERANCE)))


def detect_columns(spans: Column) -> Column:
    """Mean x of each chained cluster, left to right."""
    xs = F.sort_array(F.transform(spans, lambda s: s["x"]))
    return let(xs, lambda v: F.transform(cut(v, chained_starts(v, X_TOLERANCE)), mean))


def nearest_column(x: Column, columns: Column) -> Column:
    """Index of the nearest column, the left one on a tie."""
    return F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(x - c).alias("d"), i.alias("i"))))["i"]


def page_text(spans: Column, tolerance: float = 3.0) -> Column:
    """All spans, blank ones too, as lines of text with a fixed row tolerance."""
    rows = cluster_rows(spans, F.lit(tolerance))
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda s: s["text"]), " ")), "\n")
