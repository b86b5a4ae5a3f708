"""Text functions: Unicode trimming, byte decoding, ASCII hex and character maps.

All are column expressions that stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points with the Unicode property White_Space, as a class body that Java, RE2
#: and Python's ``regex`` read alike (fixed values).
WHITE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside a lambda."""
    return F.transform(F.array(value), body)[0]


def utrim(c: Column) -> Column:
    """Trim every White_Space character on both sides."""
    return F.regexp_replace(c, rf"^[{WHITE}]+|[{WHITE}]+\z", "")


def utrim_end(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WHITE}]+\z", "")


def latin1(b: Column) -> Column:
    """Every byte becomes the code point of its value."""
    return F.decode(b, "ISO-8859-1")


def _by_codec(codec: str, low: int, changed: dict[int, str]) -> tuple[str, str]:
    """``translate`` strings of a single-byte code page from ``low`` up."""
    own, other = [], []
    for b in range(low, 256):
        to = changed.get(b) or bytes([b]).decode(codec, "ignore") or chr(b)
        if to != chr(b):
            own.append(chr(b))
            other.append(to)
    return "".join(own), "".join(other)


WINANSI = _by_codec("cp1252", 0x80, {})
#: Three codes of the Mac set that extraction reads as plain ASCII (fixed values).
MACROMAN = _by_codec("mac_roman", 0x80, {0xCA: " ", 0xD2: '"', 0xD3: '"'})


def winansi(b: Column) -> Column:
    """Windows code page 1252; its five holes stay control characters."""
    return F.translate(latin1(b), *WINANSI)


def macroman(b: Column) -> Column:
    return F.translate(latin1(b), *MACROMAN)


def decode_default(b: Column) -> Column:
    """No encoding known: printable ASCII and Latin-1 stay, the rest is blank."""
    return F.regexp_replace(latin1(b), r"[^\x20-\x7e\xa0-\xff]", " ")


def ascii_hex_decode(c: Column) -> Column:
    """Hexadecimal text to bytes: blanks skipped, ends at ``>``, an odd last digit is
    followed by 0; null if another character occurs."""
    digits = F.regexp_replace(F.substring_index(c, ">", 1), r"[\x09\x0A\x0C\x0D\x20]+", "")
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise("")))


def _code(hexed: Column) -> Column:
    """A four-digit hexadecimal number; empty or longer ones are 0."""
    n = F.conv(hexed, 16, 10).cast("long")
    return F.when((F.length(hexed) > 0) & (n <= 0xFFFF), n).otherwise(F.lit(0)).cast("int")


def _letter(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def parse_tounicode(cmap: Column) -> Column:
    """A character map's text to ``map<int, string>``: single characters, then ranges,
    whose entries win; surrogate halves are left out."""
    hexes = r"[0-9A-Fa-f\s]*"

    def sections(kind: str) -> Column:
        return F.array_join(F.regexp_extract_all(cmap, F.lit(rf"(?s)begin{kind}(.*?)end{kind}"), F.lit(1)), "\n")

    one = rf"<({hexes})>\s*<({hexes})>"
    chars = sections("bfchar")
    low = F.regexp_extract_all(chars, F.lit(one), F.lit(1))
    to = F.regexp_extract_all(chars, F.lit(one), F.lit(2))
    clean = lambda c: F.regexp_replace(c, r"\s+", "")
    singles = F.zip_with(low, to, lambda a, b: F.struct(_code(clean(a)).alias("cid"), _code(clean(b)).alias("uni")))
    span = rf"<({hexes})>\s*<({hexes})>\s*(?:<({hexes})>|\[([^\]]*)\])"
    ranges = sections("bfrange")
    part = lambda k: F.regexp_extract_all(ranges, F.lit(span), F.lit(k))
    ends = F.zip_with(part(1), part(2), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    goals = F.zip_with(part(3), part(4), lambda a, b: F.struct(a.alias("dst"), b.alias("list")))
    rows = F.zip_with(ends, goals, lambda a, b: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"), b["dst"].alias("dst"), b["list"].alias("list")))

    def entries(r: Column) -> Column:
        lo, hi = _code(clean(r["lo"])), _code(clean(r["hi"]))
        items = F.transform(F.regexp_extract_all(r["list"], F.lit(rf"<({hexes})>"), F.lit(1)), lambda d: _code(clean(d)))
        steps = F.when(hi >= lo, F.sequence(F.lit(0), hi - lo)).otherwise(F.array().cast("array<int>"))
        run = F.transform(steps, lambda i: F.struct(((lo + i) % 65536).alias("cid"), ((_code(clean(r["dst"])) + i) % 65536).alias("uni")))
        listed = F.filter(F.transform(items, lambda u, i: F.struct((lo + i).alias("cid"), u.alias("uni"))), lambda e: e["cid"] <= hi)
        return F.when(r["list"] != "", listed).otherwise(run)

    every = F.concat(singles, F.flatten(F.transform(rows, entries)))
    every = F.filter(every, lambda e: ~e["uni"].between(0xD800, 0xDFFF))

    def mapped(rows: Column, codes: Column) -> Column:
        # rows are in reverse, so the first position of a code is its last entry
        keys = F.array_distinct(codes)
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _letter(F.element_at(rows, F.array_position(codes, k).cast("int"))["uni"])))

    return let(F.reverse(every), lambda rows: let(F.transform(rows, lambda e: e["cid"]), lambda codes: mapped(rows, codes)))


def decode_bytes(b: Column, cids: Column) -> Column:
    """Two-byte codes through a character map; an unknown code is two single bytes and an
    odd last byte stands alone. An empty map decodes byte by byte."""
    def through(m: Column) -> Column:
        digits = F.hex(b)
        steps = F.when(F.length(b) > 0, F.sequence(F.lit(0), (F.length(b) - 1).cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>"))

        def letters(i: Column) -> Column:
            code = F.substr(digits, i * 2 + 1, F.lit(4))
            known = F.when(F.length(code) == 4, F.try_element_at(m, F.conv(code, 16, 10).cast("int")))
            return F.coalesce(known, F.decode(F.unhex(code), "ISO-8859-1"))

        return F.when(F.size(m) > 0, F.array_join(F.transform(steps, letters), "")).otherwise(latin1(b))

    return let(cids, through)
