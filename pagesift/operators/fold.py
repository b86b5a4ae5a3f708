"""Ordered folds over an array that emit rows on the way, as array expressions.

``aggregate`` copies what it returns at each step, so a fold that collects its output in
its state takes quadratic time. Here the items are folded in chunks: only a chunk's own output
is copied a step, and the whole output once a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import let

#: log2 of the items folded before their output joins the rest.
CHUNK = 6


def fold(items: Column, start: Column, step: Callable[[Column, Column], Column], out_type: str, settle: Callable[[Column], Column] = lambda s: s) -> Column:
    """``struct<state, out>`` after all ``items``. ``step(state, item)`` gives the next state and
    an array of rows to emit as ``struct<state, out>``; ``settle`` may shorten a state at the end of a chunk."""
    none = F.expr(f"cast(array() as array<{out_type}>)")

    def one(acc: Column, item: Column) -> Column:
        return let(step(acc["state"], item), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    def chunk(acc: Column, part: Column) -> Column:
        folded = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(folded, lambda r: F.struct(settle(r["state"]).alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    def parts(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(a) - 1, CHUNK), F.lit(0)))
        return F.aggregate(F.transform(starts, lambda i: F.slice(a, F.shiftleft(i, CHUNK) + 1, F.lit(1 << CHUNK))), F.struct(start.alias("state"), none.alias("out")), chunk)

    return let(items, parts)
