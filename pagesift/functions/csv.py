"""Reading CSV text back, and how sizes are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import let


#: A quoted run (to the end of the text if it isn't closed), as part of a cell. The patterns
#: give nothing back and so don't recurse, however long a cell is.
_QUOTED = r'"(?:[^"]++|"")*+(?:"|\z)'


def csv_rows(text: Column) -> Column:
    """``array<array<string>>``: quoted parts of cells keep what is inside, doubled quotes are one;
    carriage returns outside quotes go, and so do rows whose cells are all empty."""
    lines = F.regexp_extract_all(text, F.lit(rf'((?:{_QUOTED}|[^"\n]++)++)'), F.lit(1))

    def part(p: Column) -> Column:
        inside = F.replace(F.regexp_extract(p, r'"((?:[^"]++|"")*+)', 1), F.lit('""'), F.lit('"'))
        return F.when(p.startswith('"'), inside).otherwise(F.replace(p, F.lit("\r"), F.lit("")))

    def cell(c: Column) -> Column:
        parts = F.regexp_extract_all(c, F.lit(rf'{_QUOTED}|[^"]++'), F.lit(0))
        return F.when(F.contains(c, F.lit('"')), F.array_join(F.transform(parts, part), "")).otherwise(F.replace(c, F.lit("\r"), F.lit("")))

    # with a comma before it, the first cell is found like any other, also if it is empty
    cells = lambda line: F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf',((?:{_QUOTED}|[^",]++)*+)'), F.lit(1)), cell)
    return F.filter(F.transform(lines, cells), lambda row: F.exists(row, lambda c: c != ""))


def row_count(text: Column) -> Column:
    """Rows of CSV text without the header; none if there is no row."""
    return let(F.size(csv_rows(text)), lambda n: F.greatest(n - 1, F.lit(0)))


def format_size(size: Column) -> Column:
    """Bytes, or kilobytes and megabytes to one decimal, halves rounded up."""
    tenths = lambda unit: F.shiftright(size * 10 + unit // 2, unit.bit_length() - 1)
    shown = lambda unit, name: let(tenths(unit), lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(name)))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, shown(1024, " KB")).otherwise(shown(1 << 20, " MB"))
