"""Content streams to spans: tokens to operators by array expressions, then a fold over a page's
operators.

An operator row is ``op`` with its operands: ``nums`` (numbers in order), ``name`` (a font), ``text``
(a shown string, one code a character) and ``items`` (strings and kernings of ``TJ``, each row one of the
two). The fold's state is the text state with its stack of saved states; shown text leaves it as
spans. Operators without their operands, and unknown ones, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import syntax
from pagesift.functions.text import MACROMAN, WINANSI, decode_bytes, let, utrim
from pagesift.operators.fold import fold
from pagesift.operators.merge import renumbered
from pagesift.schema import SPAN

OPERATOR = "struct<op:string,nums:array<double>,name:string,text:string,items:array<struct<text:string,kern:double>>>"
#: Kerning beyond this many thousandths of the size ends a span; an advance is this share of
#: the size a character (fixed values).
WORD_KERN, ADVANCE = 200, 0.5
_FIELDS = ["x", "y", "line_x", "line_y", "leading", "size", "font"]
_TEXT = "x:double,y:double,line_x:double,line_y:double,leading:double,size:double,font:string"
_START = f"cast(struct(0, 0, 0, 0, 0, 12, null, array()) as struct<{_TEXT},saved:array<struct<{_TEXT}>>>)"
_NO_SPANS = f"cast(array() as array<{SPAN}>)"


def _with(s: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(f, s[f]).alias(f) for f in (*_FIELDS, "saved")])


def _to_line(s: Column, x: Column, y: Column, **more: Column) -> Column:
    return _with(s, x=x, y=y, line_x=x, line_y=y, **more)


def _moved(s: Column, o: Column) -> Column:
    """The state after what an operator does before it shows anything."""
    op, nums = o["op"], F.coalesce(o["nums"], F.expr("cast(array() as array<double>)"))
    n = F.size(nums)
    last = lambda k: F.try_element_at(nums, F.lit(-k))
    zero = F.lit(0.0)
    kept = F.struct(*[s[f].alias(f) for f in _FIELDS])
    back = let(F.try_element_at(s["saved"], F.lit(-1)), lambda top: F.struct(*[top[f].alias(f) for f in _FIELDS], F.slice(s["saved"], F.lit(1), F.greatest(F.size(s["saved"]) - 1, F.lit(0))).alias("saved")))
    by = s["line_x"] + last(2), s["line_y"] + last(1)
    return (
        F.when(op == "q", _with(s, saved=F.concat(s["saved"], F.array(kept))))
        .when((op == "Q") & (F.size(s["saved"]) > 0), back)
        .when(op == "BT", _to_line(s, zero, zero))
        .when(op == "Tf", _with(s, font=F.coalesce(o["name"], s["font"]), size=F.coalesce(last(1), s["size"])))
        .when((op == "TL") & (n >= 1), _with(s, leading=last(1)))
        .when((op == "Td") & (n >= 2), _to_line(s, *by))
        .when((op == "TD") & (n >= 2), _to_line(s, *by, leading=-last(1)))
        .when((op == "Tm") & (n >= 6), _to_line(s, F.get(nums, F.lit(4)), F.get(nums, F.lit(5))))
        .when(op.isin("T*", "'", '"'), _to_line(s, s["line_x"], s["line_y"] - s["leading"]))
        .otherwise(s)
    )


def as_shown(font: Column, text: Column) -> Column:
    """Texts of an operator table are read already."""
    return text


def by_default(font: Column, text: Column) -> Column:
    """Bytes of a font of which nothing is known: printable ASCII and Latin-1 stay."""
    return F.regexp_replace(text, r"[^\x20-\x7e\xa0-\xff]", " ")


def by_fonts(fonts: Column) -> Callable[[Column, Column], Column]:
    """Bytes through their font's entry in ``map<string, struct<encoding, cids>>``: a character map,
    or the code page of that name (any other is Windows'). Fonts that aren't listed are read by default."""

    def read(font: Column, text: Column) -> Column:
        def through(f: Column) -> Column:
            page = F.when(f["encoding"] == "MacRomanEncoding", F.translate(text, *MACROMAN)).otherwise(F.translate(text, *WINANSI))
            mapped = F.when(F.size(f["cids"]) > 0, decode_bytes(F.encode(text, "ISO-8859-1"), f["cids"]))
            return F.when(f.isNull(), by_default(font, text)).otherwise(F.coalesce(mapped, page))

        return let(F.when(font.isNotNull(), F.try_element_at(fonts, font)), through)

    return read


Reading = Callable[[Column, Column], Column]


def _span(s: Column, text: Column, x: Column, read: Reading) -> Column:
    """The shown text as an array of one span; blank text is one blank, empty text none."""
    shown = let(utrim(read(s["font"], text)), lambda t: F.when(t == "", " ").otherwise(t))
    row = F.struct(F.lit(0).alias("ord"), shown.alias("text"), x.alias("x"), s["y"].alias("y"), s["size"].alias("font_size"), s["font"].alias("font_name"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.expr(_NO_SPANS)).otherwise(F.array(row))


def _advance(s: Column, text: Column) -> Column:
    return F.length(text) * s["size"] * ADVANCE


def _kerned(s: Column, items: Column, read: Reading) -> Column:
    """``struct<x, out>`` of an array of strings and kernings."""
    start = F.struct(s["x"].alias("x"), F.lit(None).cast("string").alias("held"), s["x"].alias("at"), F.expr(_NO_SPANS).alias("out"))

    def step(acc: Column, item: Column) -> Column:
        text, kern = item["text"], item["kern"]
        ends = (F.abs(kern) > WORD_KERN) & acc["held"].isNotNull()
        grown = F.struct((acc["x"] + _advance(s, text)).alias("x"), F.concat(F.coalesce(acc["held"], F.lit("")), text).alias("held"), F.when(acc["held"].isNull(), acc["x"]).otherwise(acc["at"]).alias("at"), acc["out"].alias("out"))
        shifted = F.struct(
            (acc["x"] - F.coalesce(kern, F.lit(0.0)) / 1000.0 * s["size"]).alias("x"),
            F.when(~F.coalesce(ends, F.lit(False)), acc["held"]).alias("held"),
            acc["at"].alias("at"),
            F.when(ends, F.concat(acc["out"], _span(s, acc["held"], acc["at"], read))).otherwise(acc["out"]).alias("out"),
        )
        return F.when(text.isNotNull(), grown).otherwise(shifted)

    done = F.aggregate(items, start, step)
    return let(done, lambda r: F.struct(r["x"].alias("x"), F.concat(r["out"], _span(s, r["held"], r["at"], read)).alias("out")))


def _step(state: Column, o: Column, read: Reading) -> Column:
    def shown(s: Column) -> Column:
        plain = o["op"].isin("Tj", "'", '"') & o["text"].isNotNull()
        kerned = let(_kerned(s, o["items"], read), lambda r: F.struct(_with(s, x=r["x"]).alias("state"), r["out"].alias("out")))
        return (
            F.when(plain, F.struct(_with(s, x=s["x"] + _advance(s, o["text"])).alias("state"), _span(s, o["text"], s["x"], read).alias("out")))
            .when((o["op"] == "TJ") & o["items"].isNotNull(), kerned)
            .otherwise(F.struct(s.alias("state"), F.expr(_NO_SPANS).alias("out")))
        )

    return let(_moved(state, o), shown)


def content_operators(content: Column) -> Column:
    """``array<operator>`` of a content stream's bytes. A dictionary or a stray byte is an
    operator without a name, which drops the operands before it; null if a number is none."""
    number = lambda t: t.try_cast("double")
    none = F.expr("cast(array() as array<double>)")

    def item(t: Column) -> Column:
        text = F.when(syntax.is_string(t), syntax.string_bytes(t))
        return F.struct(text.alias("text"), F.when(syntax.is_number(t), number(t)).alias("kern"))

    def operator(tokens: Column, start: Column, end: Column) -> Column:
        def made(args: Column) -> Column:
            op, n = F.get(tokens, end), F.size(args)
            last, second = F.try_element_at(args, F.lit(-1)), F.try_element_at(args, F.lit(-2))
            two = F.when(syntax.is_number(last) & syntax.is_number(second), F.array(number(second), number(last))).when(syntax.is_number(last), F.array(number(last)))
            nums = F.when(op == "Tm", F.transform(F.filter(args, syntax.is_number), number)).when(op == "Tf", F.when((n >= 2) & syntax.is_number(last), F.array(number(last)))).otherwise(two)
            listed = F.filter(F.transform(syntax.found(F.substring(last, 2, 1 << 30), syntax.CONTENT), item), lambda i: i["text"].isNotNull() | i["kern"].isNotNull())
            return F.struct(
                F.when(op.rlike(r"\A[A-Za-z'\"]"), op).otherwise("").alias("op"),
                F.coalesce(nums, none).alias("nums"),
                F.when((op == "Tf") & second.startswith("/"), F.substring(second, 2, 1 << 30)).alias("name"),
                F.when(op.isin("Tj", "'", '"') & syntax.is_string(last), syntax.string_bytes(last)).alias("text"),
                F.when((op == "TJ") & last.startswith("["), listed).alias("items"),
            )

        return let(F.slice(tokens, start + 1, end - start), made)

    def split(tokens: Column) -> Column:
        boundary = lambda t: ~syntax.begins(t, "(<[/+-.0123456789") | t.startswith("<<")
        ends = F.filter(F.transform(tokens, lambda t, i: F.when(boundary(t), i)), lambda i: i.isNotNull())
        rows = let(ends, lambda e: F.transform(e, lambda end, k: operator(tokens, F.when(k > 0, F.get(e, k - 1) + 1).otherwise(0), end)))
        bad = F.exists(tokens, lambda t: syntax.is_number(t) & number(t).isNull())
        return F.when(~bad, rows)

    text = F.decode(content, "ISO-8859-1")
    return let(F.filter(syntax.found(text, syntax.CONTENT), lambda t: ~t.startswith("%")), split)


def content_spans(content: Column, fonts: Column | None = None) -> Column:
    """``array<span>`` of a content stream's bytes, before merging: the whole way in the JVM."""
    return operator_spans(content_operators(content), by_default if fonts is None else by_fonts(fonts))


def operator_spans(operators: Column, read: Reading = as_shown) -> Column:
    """``array<span>`` of a page's operators in order, before merging. ``read`` turns what is shown in
    a font to text."""
    done = fold(operators, F.expr(_START), lambda s, o: _step(s, o, read), SPAN)
    return F.transform(done["out"], renumbered)


def pages_of_operators(rows: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """``key, spans`` from a table of operators: one row an operator, numbered by ``order`` within
    a page. A page's operators are gathered, which is bounded by the page."""
    one = F.struct(F.col(order).alias("seq"), *[F.col(c) for c in ("op", "nums", "name", "text", "items")])
    pages = rows.groupBy(*key).agg(F.sort_array(F.collect_list(one)).alias("ops"))
    return pages.select(*key, operator_spans(F.col("ops")).alias("spans"))
