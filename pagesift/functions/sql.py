"""The engine's column functions as SQL functions.

A function is created as ``CREATE TEMPORARY FUNCTION name(..) RETURN expression``; the expression's
text is rendered from the column itself, so there is one definition. The optimizer puts it in place of each
call: there is no Python and no call left in the plan. Names don't hide built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagesift.functions import csv, syntax, text
from pagesift.operators import cluster, content, layout, merge, objects, render, table
from pagesift.schema import ELEMENT, SPAN, TABLE

#: String literals, which stay as they are; operators in call form; fractional numbers.
_PARTS = re.compile(r"(?P<text>'(?:[^'\\]|\\.)*')|(?P<call><=>|<=|>=|!=|[-=!*+/%<>&|^~]|\b(?:or|and|not|in)\b)(?=\()|(?P<number>(?<![\w.])\d+\.\d+(?:E-?\d+)?(?![\w.]))")


def sql_text(column: Column) -> str:
    """SQL text of a column built from functions and lambdas: operators are called by their quoted
    names, fractional literals are doubles. Columns of a classic session only."""

    def shown(m: re.Match) -> str:
        if m["call"]:
            return f"`{m['call']}`"
        return f"{m['number']}D" if m["number"] else m[0]

    return _PARTS.sub(shown, column._jc.node().sql())


_SPANS, _ELEMENTS = f"ARRAY<{SPAN}>", f"ARRAY<{ELEMENT}>"
_grid = table.table_from_spans
#: Name: parameters with types, result, definition.
FUNCTIONS: dict[str, tuple[dict[str, str], str, Callable[..., Column]]] = {
    "spans_drop_blank": ({"spans": _SPANS}, _SPANS, cluster.drop_blank),
    "spans_merge": ({"spans": _SPANS}, _SPANS, merge.merge_spans),
    "spans_row_tolerance": ({"spans": _SPANS}, "DOUBLE", cluster.row_tolerance),
    "spans_rows": ({"spans": _SPANS}, f"ARRAY<{_SPANS}>", lambda s: cluster.cluster_rows(s, cluster.row_tolerance(s))),
    "spans_columns": ({"spans": _SPANS}, "ARRAY<DOUBLE>", cluster.detect_columns),
    "spans_body_size": ({"spans": _SPANS}, "DOUBLE", lambda s: layout.body_font_size(cluster.drop_blank(s))),
    "spans_page_text": ({"spans": _SPANS}, "STRING", cluster.page_text),
    "spans_table": ({"spans": _SPANS}, TABLE, _grid),
    "spans_to_csv": ({"spans": _SPANS}, "STRING", lambda s: render.to_csv(_grid(s))),
    "spans_to_tsv": ({"spans": _SPANS}, "STRING", lambda s: render.to_tsv(_grid(s))),
    "spans_to_text": ({"spans": _SPANS}, "STRING", lambda s: render.to_text(_grid(s))),
    "spans_elements": ({"spans": _SPANS}, _ELEMENTS, layout.elements),
    "elements_to_txt": ({"elements": _ELEMENTS}, "STRING", render.elements_to_txt),
    "elements_to_markdown": ({"elements": _ELEMENTS}, "STRING", render.elements_to_markdown),
    "operator_spans": ({"operators": f"ARRAY<{content.OPERATOR}>"}, _SPANS, content.operator_spans),
    "stream_operators": ({"content": "BINARY"}, f"ARRAY<{content.OPERATOR}>", content.content_operators),
    "stream_spans": ({"content": "BINARY"}, _SPANS, content.content_spans),
    "parse_object": ({"body": "STRING"}, "VARIANT", syntax.parse_object),
    "xref_table": ({"body": "STRING"}, "ARRAY<STRUCT<number: BIGINT, offset: BIGINT, generation: INT, in_use: BOOLEAN>>", objects.xref_table),
    "find_startxref": ({"content": "BINARY"}, "BIGINT", objects.startxref),
    "csv_cells": ({"body": "STRING"}, "ARRAY<ARRAY<STRING>>", csv.csv_rows),
    "csv_row_count": ({"body": "STRING"}, "INT", csv.row_count),
    "format_size": ({"size": "BIGINT"}, "STRING", csv.format_size),
    "decode_winansi": ({"bytes": "BINARY"}, "STRING", text.winansi),
    "decode_macroman": ({"bytes": "BINARY"}, "STRING", text.macroman),
    "decode_identity": ({"bytes": "BINARY"}, "STRING", text.latin1),
    "decode_default": ({"bytes": "BINARY"}, "STRING", text.decode_default),
    "ascii_hex_decode": ({"digits": "STRING"}, "BINARY", text.ascii_hex_decode),
    "parse_tounicode": ({"cmap": "STRING"}, "MAP<INT, STRING>", text.parse_tounicode),
    "decode_codes": ({"bytes": "BINARY", "cids": "MAP<INT, STRING>"}, "STRING", text.decode_bytes),
    "xref_records": ({"data": "BINARY", "widths": "ARRAY<INT>", "ranges": "ARRAY<STRUCT<first: BIGINT, count: BIGINT>>"}, "ARRAY<STRUCT<number: BIGINT, kind: BIGINT, a: BIGINT, b: BIGINT>>", objects.xref_records),
}


def register(spark: SparkSession, *names: str) -> None:
    """Create the functions of that name, or all, in the session."""
    for name in names or FUNCTIONS:
        params, result, define = FUNCTIONS[name]
        body = sql_text(define(*[F.col(p) for p in params]))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} {t}' for p, t in params.items())}) RETURNS {result} RETURN {body}")
