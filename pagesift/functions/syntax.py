"""Tokens of page content and of object text as column expressions: one pattern finds them all, array
functions sort and decode them. Text is bytes as Latin-1, a character a byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import let

#: Levels of brackets within brackets that the patterns follow.
DEPTH = 24


def _nested(opening: str, closing: str, plain: str, depth: int = DEPTH) -> str:
    """What stands between two brackets, with brackets of the kind inside; without its closing
    bracket a part reaches to the end of the text. Nothing is given back, so nothing recurses."""
    inside = rf"(?:{plain})*+"
    for _ in range(depth):
        inside = rf"(?:{plain}|{opening}{inside}(?:{closing}|\z))*+"
    return inside


_IN_STRING = _nested(r"\(", r"\)", r"[^()\\]++|\\(?:[\s\S]|\z)")
STRING = rf"\({_IN_STRING}(?:\)|\z)"
_IN_DICT = _nested("<<", ">>", r"(?!<<|>>)[\s\S]", 6)
_COMMENT = r"%[^\n]*+"
_HEX = r"<[^>]*+(?:>|\z)"
_IN_ARRAY = _nested(r"\[", r"\]", rf"{_COMMENT}|{STRING}|<<{_IN_DICT}(?:>>|\z)|{_HEX}|[^\[\]%(<]", 4)
_NUMBER = r"[+-][0-9.]*+|[0-9.]++"
#: Tokens of a content stream. A dictionary, and a byte that begins nothing, are tokens too: they end
#: the operands before them.
CONTENT = rf"{_COMMENT}|{STRING}|<<{_IN_DICT}(?:>>|\z)|{_HEX}|\[{_IN_ARRAY}(?:\]|\z)|/[A-Za-z0-9_+.\-]*+|{_NUMBER}|[A-Za-z'\"][A-Za-z*'\"]*+|[^\x00\x09\x0A\x0C\x0D\x20]"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?:{pattern})"), F.lit(0))


def begins(token: Column, signs: str) -> Column:
    """Whether a token that is not empty begins with one of ``signs``: a set of codes, where a pattern
    would make each token a Java string."""
    return F.ascii(token).isin(*map(ord, signs))


def is_number(token: Column) -> Column:
    return begins(token, "+-.0123456789")


def is_string(token: Column) -> Column:
    return token.startswith("(") | token.startswith("<") & ~token.startswith("<<")


def unescaped(body: Column) -> Column:
    """The characters of a bracketed string: one for a letter or an octal number after a
    backslash, none for a line end after it."""
    letters = F.create_map(*[F.lit(c) for pair in ("n\n", "r\r", "t\t", "b\b", "f\f") for c in pair])

    def one(piece: Column) -> Column:
        c = F.substring(piece, 2, 9)
        code = F.char((F.conv(c, 8, 10).cast("int") % 256))
        plain = F.when(c.isin("", "\n", "\r", "\r\n"), "").otherwise(F.coalesce(F.try_element_at(letters, c), c))
        return F.when(~piece.startswith("\\"), piece).when(c.rlike(r"\A[0-7]"), code).otherwise(plain)

    pieces = found(body, r"\\(?:[0-7]{1,3}|\r\n|[\s\S]|\z)|[^\\]++")
    return F.when(F.contains(body, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(body)


def string_bytes(token: Column) -> Column:
    """A string token's bytes as Latin-1: bracketed or hexadecimal, an odd last digit followed by 0."""
    digits = F.regexp_replace(token, "[^0-9A-Fa-f]", "")
    hexed = F.decode(F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise(""))), "ISO-8859-1")
    return F.when(token.startswith("<"), hexed).otherwise(unescaped(F.regexp_extract(token, rf"\A\(({_IN_STRING})", 1)))


#: Tokens of an object's text; a reference is one token.
_BLANK = r"(?:[\x00\x09\x0A\x0C\x0D\x20]|%[^\r\n]*+)"
OBJECT = rf"%[^\r\n]*+|{STRING}|<<|>>|<[^>]*+(?:>|\z)|\[|\]|/[^\x00\x09\x0A\x0C\x0D\x20()<>\[\]{{}}/%]*+|[0-9]++{_BLANK}++[0-9]++{_BLANK}++R(?![A-Za-z])|[+-]?[0-9]*+\.?[0-9]++|[+-]?[0-9]++\.?|[A-Za-z]++|[^\x00\x09\x0A\x0C\x0D\x20]"


def name_text(token: Column) -> Column:
    """A name without its slash, ``#xx`` being a byte, read as UTF-8."""
    pieces = found(F.substring(token, 2, 1 << 30), "#[0-9A-Fa-f]{2}|[^#]++|#")
    raw = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"\A#[0-9A-Fa-f]{2}"), F.decode(F.unhex(F.substring(p, 2, 2)), "ISO-8859-1")).otherwise(p)), "")
    return F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8")


def _quoted(text: Column) -> Column:
    shown = F.to_json(F.array(text))
    return F.substring(shown, F.lit(2), F.length(shown) - 2)


def object_json(text: Column) -> Column:
    """An object's text as JSON, for ``parse_json``: names are ``{"/": name}``, references
    ``{"R": [number, generation]}``, strings hold a character a byte. Null if a token is none. A fold
    over the tokens with the open brackets as its state: ``a`` in an array, ``k`` and ``v`` where a dictionary's
    key or value comes next."""

    def step(acc: Column, t: Column) -> Column:
        top = F.substring(acc["open"], -1, 1)
        below = F.substring(acc["open"], F.lit(1), F.length(acc["open"]) - 1)
        number = lambda k: F.regexp_extract(t, rf"\A([0-9]++){_BLANK}++([0-9]++)", k).try_cast("bigint").cast("string")
        plain = (
            F.when(t.startswith("/"), F.concat(F.lit('{"/":'), _quoted(name_text(t)), F.lit("}")))
            .when(is_string(t), _quoted(string_bytes(t)))
            .when(t.rlike(r"(?s)\A[0-9].*R\z"), F.concat(F.lit('{"R":['), number(1), F.lit(","), number(2), F.lit("]}")))
            .when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("bigint").cast("string"))
            .when(t.rlike(r"\A[+-]?[0-9]*\.?[0-9]*\z"), t.try_cast("double").cast("string"))
            .when(t.isin("true", "false", "null"), t)
        )
        comma = F.when(acc["some"] & (top == "a") | acc["some"] & (top == "k"), ",").otherwise("")
        valued = F.when(top == "v", F.concat(below, F.lit("k"))).otherwise(acc["open"])
        outer = F.when(F.substring(below, -1, 1) == "v", F.concat(F.substring(below, F.lit(1), F.length(below) - 1), F.lit("k"))).otherwise(below)
        put = lambda piece, opened, some: F.struct(F.concat(acc["out"], F.array(piece)).alias("out"), opened.alias("open"), F.lit(some).alias("some"))
        return (
            F.when(t == "<<", put(F.concat(comma, F.lit("{")), F.concat(acc["open"], F.lit("k")), False))
            .when(t == "[", put(F.concat(comma, F.lit("[")), F.concat(acc["open"], F.lit("a")), False))
            .when((t == ">>") & (top == "k"), put(F.lit("}"), outer, True))
            .when((t == "]") & (top == "a"), put(F.lit("]"), outer, True))
            .when((top == "k") & t.startswith("/"), put(F.concat(comma, _quoted(name_text(t)), F.lit(":")), F.concat(below, F.lit("v")), False))
            .when(top == "k", put(F.lit(None).cast("string"), acc["open"], True))
            .otherwise(put(F.concat(comma, plain), valued, True))
        )

    tokens = F.filter(found(text, OBJECT), lambda t: ~t.startswith("%"))
    start = F.expr("struct(cast(array() as array<string>) as out, '' as open, false as some)")
    done = F.aggregate(tokens, start, step)
    return let(done, lambda r: F.when((r["open"] == "") & (F.size(r["out"]) > 0) & ~F.exists(r["out"], lambda p: p.isNull()), F.array_join(r["out"], "")))


def parse_object(text: Column) -> Column:
    """An object's text as a VARIANT; null if it is malformed."""
    return F.try_parse_json(object_json(text))
