"""Joining neighbouring spans of a line, as an ordered fold over a page's array.

The fold's state is the open text's head (whose line, font and width rule), the last
span's place and length, and the texts joined so far. A span either joins the open text or
closes it and opens its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import let
from pagesift.operators import cluster
from pagesift.operators.fold import fold
from pagesift.schema import SPAN

#: Share of the font size that is one line and one character, and the gaps
#: (in characters) up to which single characters, runs and words are joined.
LINE, WIDTH, SINGLE, RUN, BACK, WORD = 0.3, 0.5, 3.0, 0.8, -2.0, 2.0
_STATE = f"struct<head:{SPAN},last_x:double,last_n:int,parts:array<string>>"


def line_order(spans: Column) -> Column:
    """Lines from the top, and left to right within a line; emission order on a tie. A line
    reaches from its highest span down by ``LINE`` of that span's size, which orders any page
    (comparing pairs of spans with a tolerance would not)."""

    def step(acc: Column, s: Column) -> Column:
        same = acc["y"].isNotNull() & (acc["y"] - s["y"] <= acc["reach"])
        return F.struct(
            F.when(same, acc["y"]).otherwise(s["y"]).alias("y"),
            F.when(same, acc["reach"]).otherwise(s["font_size"] * LINE).alias("reach"),
            F.when(same, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"),
            (acc["i"] + 1).alias("i"),
        )

    none = F.expr("struct(cast(null as double) as y, cast(null as double) as reach, cast(array() as array<int>) as starts, 0 as i)")
    in_line = lambda row: F.transform(F.sort_array(F.transform(row, lambda s: F.struct(s["x"].alias("x"), s["ord"].alias("ord"), s.alias("s")))), lambda k: k["s"])
    lines = lambda s: let(F.aggregate(s, none, step, lambda acc: acc["starts"]), lambda at: cluster.cut(s, at))
    return F.flatten(F.transform(let(cluster.reading_order(spans), lines), in_line))


def _between(state: Column, span: Column) -> Column:
    """What stands between the last span and this one in one text; null if they are apart."""
    head, width = state["head"], state["head"]["font_size"] * WIDTH
    gap = span["x"] - (state["last_x"] + state["last_n"] * width)
    apart = head.isNull() | (F.abs(span["y"] - head["y"]) > head["font_size"] * LINE) | ~head["font_name"].eqNullSafe(span["font_name"])
    single = (state["last_n"] <= 1) & (F.length(span["text"]) <= 1)
    near = F.when((gap < width * SINGLE) & (gap > -width * SINGLE), "")
    return F.when(apart, None).when(single, near).when((gap < width * RUN) & (gap > width * BACK), "").when(gap < width * WORD, " ")


def renumbered(span: Column, ord: Column) -> Column:
    """The span with its place in a page as its number."""
    return F.struct(ord.alias("ord"), *[span[c].alias(c) for c in ("text", "x", "y", "font_size", "font_name")])


def _closed(state: Column) -> Column:
    """The open text as an array of one span, or none."""
    head = state["head"]
    made = F.struct(head["ord"].alias("ord"), F.array_join(state["parts"], "").alias("text"), *[head[c].alias(c) for c in ("x", "y", "font_size", "font_name")])
    return F.when(head.isNull(), F.expr(f"cast(array() as array<{SPAN}>)")).otherwise(F.array(made))


def _step(state: Column, span: Column) -> Column:
    return let(_between(state, span), lambda by: _joined(state, span, by))


def _joined(state: Column, span: Column, by: Column) -> Column:
    at = span["x"].alias("last_x"), F.length(span["text"]).alias("last_n")
    more = F.struct(state["head"].alias("head"), *at, F.concat(state["parts"], F.array(by, span["text"])).alias("parts"))
    fresh = F.struct(span.alias("head"), *at, F.array(span["text"]).alias("parts"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return F.when(by.isNotNull(), F.struct(more.alias("state"), none.alias("out"))).otherwise(F.struct(fresh.alias("state"), _closed(state).alias("out")))


def merge_spans(spans: Column) -> Column:
    """``array<span>`` with neighbours on a line in one font joined at the first one's place,
    numbered anew."""
    start = F.expr(f"cast(struct(null, null, 0, array()) as {_STATE})")
    settle = lambda s: F.struct(*[s[c].alias(c) for c in ("head", "last_x", "last_n")], F.array(F.array_join(s["parts"], "")).alias("parts"))
    done = let(fold(line_order(spans), start, _step, SPAN, settle), lambda r: F.concat(r["out"], _closed(r["state"])))
    return F.transform(done, renumbered)


def merged_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, spans`` with neighbouring spans joined."""
    return pages.select("doc_id", "page_no", merge_spans(F.col("spans")).alias("spans"))
