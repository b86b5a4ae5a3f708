"""Font encodings: byte tables and two-byte character maps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pagesift.functions.text import MACROMAN, WINANSI

_TABLES = {"WinAnsiEncoding": str.maketrans(*WINANSI), "MacRomanEncoding": str.maketrans(*MACROMAN)}
_UNKNOWN = re.compile(r"[^\x20-\x7e\xa0-\xff]")
_HEX = r"<([0-9A-Fa-f\s]*)>"


@dataclass
class Encoding:
    table: dict = field(default_factory=dict)
    cids: dict = field(default_factory=dict)

    def decode(self, data: bytes) -> str:
        if not self.cids:
            return data.decode("latin-1").translate(self.table)
        out = []
        for i in range(0, len(data), 2):
            pair = data[i : i + 2]
            known = self.cids.get(int.from_bytes(pair)) if len(pair) == 2 else None
            out.append(pair.decode("latin-1").translate(self.table) if known is None else known)
        return "".join(out)


def decode_default(data: bytes) -> str:
    return _UNKNOWN.sub(" ", data.decode("latin-1"))


def _digits(text: str) -> str:
    return "".join(text.split())


def _code(text: str) -> int:
    n = int(_digits(text) or "0", 16)
    return n if n <= 0xFFFF else 0


def _one_unit(text: str) -> str | None:
    n = _code(text) if len(_digits(text)) <= 4 else 0
    return None if 0xD800 <= n <= 0xDFFF else chr(n)


def _of_units(text: str) -> str | None:
    """A destination: UTF-16 of one or more units; None for a lone surrogate."""
    digits = _digits(text)
    try:
        return chr(_code(digits)) if len(digits) <= 4 and not 0xD800 <= _code(digits) <= 0xDFFF else bytes.fromhex(digits).decode("utf-16-be")
    except ValueError:
        return None


def parse_tounicode(cmap: bytes, compat: bool = False) -> dict[int, str]:
    """Single characters, then ranges, whose entries win. In ``compat`` a destination of more
    than four digits counts as the number 0."""
    _letters = _one_unit if compat else _of_units
    text, found = cmap.decode("latin-1"), {}
    sections = lambda kind: re.findall(rf"begin{kind}(.*?)end{kind}", text, re.S)
    for section in sections("bfchar"):
        found.update((_code(a), _letters(b)) for a, b in re.findall(rf"{_HEX}\s*{_HEX}", section))
    for section in sections("bfrange"):
        for low, high, first, listed in re.findall(rf"{_HEX}\s*{_HEX}\s*(?:{_HEX}|\[([^\]]*)\])", section):
            codes = range(_code(low), _code(high) + 1)
            if listed:
                found.update(zip(codes, map(_letters, re.findall(_HEX, listed)), strict=False))
            else:
                head, last = _digits(first)[:-4], _code(_digits(first)[-4:])
                if compat and head:
                    head, last = "", 0
                found.update((c, _letters(f"{head}{(last + i) % 65536:04X}")) for i, c in enumerate(codes))
    return {c: t for c, t in found.items() if t is not None}


def named(encoding: str | None) -> Encoding:
    """A code page by name; any other name means Windows."""
    return Encoding(_TABLES.get(encoding, _TABLES["WinAnsiEncoding"]))
