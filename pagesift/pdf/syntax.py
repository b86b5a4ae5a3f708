"""Tokens and objects of PDF files.

Names become :class:`Name`, references :class:`Ref`, streams :class:`Stream`; numbers,
bytes, lists, dicts, booleans and None stand for themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pagesift.pdf.errors import PdfError, parse_error

_BLANK = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?\d*\.?\d*")
_WORD = re.compile(rb"[A-Za-z]+")
_NAME = re.compile(rb"/([^\0\t\n\f\r ()<>\[\]{}/%]*)")
_NAME_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
_REFERENCE = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)+(\d+)(?:[\0\t\n\f\r ]+|%[^\r\n]*)+R(?![A-Za-z])")
_STRING_STOP = re.compile(rb"[()\\]")
_STRING_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)?", re.S)
_EOL = re.compile(rb"\r\n|\n|\r")
#: Words with a meaning in a file (fixed values).
WORDS = {b"true", b"false", b"null", b"obj", b"endobj", b"stream", b"endstream", b"xref", b"trailer", b"startxref", b"R"}
#: What a letter after a backslash stands for (fixed values).
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    __slots__ = ()


class Word(bytes):
    """A keyword or a closing bracket."""

    __slots__ = ()


class Ref(NamedTuple):
    number: int
    generation: int


@dataclass
class Stream:
    entries: dict
    data: bytes


def skip_blank(data: bytes, at: int) -> int:
    return _BLANK.match(data, at).end()


def _unescape(m: re.Match) -> bytes:
    c = m[1]
    if c is None or c in (b"\n", b"\r", b"\r\n"):
        return b""
    return bytes([int(c, 8) & 255]) if c[0] in b"01234567" else ESCAPES.get(c, c)


def literal_string(data: bytes, at: int, open_ended: bool = False) -> tuple[bytes, int]:
    """The string whose opening bracket is at ``at``, and where it ends. Without its
    closing bracket it is an error, unless ``open_ended``."""
    depth, pos = 1, at + 1
    while depth:
        stop = _STRING_STOP.search(data, pos)
        if stop is None:
            if not open_ended:
                raise parse_error("string without an end", len(data))
            return _STRING_ESCAPE.sub(_unescape, data[at + 1 :]), len(data)
        pos = stop.end() + (stop[0] == b"\\")
        depth += {b"(": 1, b")": -1}.get(stop[0], 0)
    return _STRING_ESCAPE.sub(_unescape, data[at + 1 : pos - 1]), pos


def hex_bytes(digits: bytes) -> bytes:
    """Hexadecimal digits to bytes; an odd last digit is followed by 0."""
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


def _hex_string(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b">", at)
    if end < 0:
        raise parse_error("string without an end", len(data))
    digits = re.sub(rb"[\0\t\n\f\r ]", b"", data[at + 1 : end])
    if not re.fullmatch(rb"[0-9A-Fa-f]*", digits):
        raise parse_error("invalid hexadecimal digit", at)
    return hex_bytes(digits), end + 1


def _name(data: bytes, at: int) -> tuple[Name, int]:
    m = _NAME.match(data, at)
    try:
        return Name(_NAME_ESCAPE.sub(lambda e: bytes.fromhex(e[1].decode()), m[1]).decode("utf-8")), m.end()
    except UnicodeDecodeError:
        raise PdfError("InvalidUtf8", "name is not UTF-8", at) from None


def _number(data: bytes, at: int):
    m = _NUMBER.match(data, at)
    try:
        return (float if b"." in m[0] else int)(m[0]), m.end()
    except ValueError:
        raise parse_error("invalid number", at) from None


def token(data: bytes, at: int):
    """The token at or after ``at`` and its end; a None token at the end of data."""
    at = skip_blank(data, at)
    c = data[at : at + 1]
    if not c:
        return None, at
    if c == b"/":
        return _name(data, at)
    if c == b"(":
        return literal_string(data, at)
    if data[at : at + 2] in (b"<<", b">>"):
        return Word(data[at : at + 2]), at + 2
    if c == b"<":
        return _hex_string(data, at)
    if c in b"[]":
        return Word(c), at + 1
    if c in b"+-.0123456789":
        return _number(data, at)
    word = _WORD.match(data, at)
    if word is None or word[0] not in WORDS:
        raise parse_error(f"unexpected {(word[0] if word else c)!r}", at)
    return Word(word[0]), word.end()


def tokens(data: bytes):
    """``(kind, value, position)`` of every token."""
    at = 0
    while True:
        start = skip_blank(data, at)
        t, at = token(data, start)
        if t is None:
            return
        kind = "word" if isinstance(t, Word) else "name" if isinstance(t, Name) else {bytes: "string", int: "int", float: "real"}[type(t)]
        yield kind, t.decode("latin-1") if isinstance(t, bytes) else str(t), start


def as_bool(obj) -> bool | None:
    return obj if isinstance(obj, bool) else None


def as_int(obj) -> int | None:
    return obj if type(obj) is int else None


def as_real(obj) -> float | None:
    return float(obj) if type(obj) in (int, float) else None


def as_string(obj) -> bytes | None:
    return obj if type(obj) is bytes else None


def as_name(obj) -> str | None:
    return str(obj) if isinstance(obj, Name) else None


def as_array(obj) -> list | None:
    return obj if isinstance(obj, list) else None


def as_dict(obj) -> dict | None:
    """A dictionary's entries, or a stream's."""
    return obj.entries if isinstance(obj, Stream) else obj if isinstance(obj, dict) else None


def as_stream(obj) -> tuple[dict, bytes] | None:
    return (obj.entries, obj.data) if isinstance(obj, Stream) else None


def as_ref(obj) -> Ref | None:
    return obj if isinstance(obj, Ref) else None


def kind_of(obj) -> str:
    """The name of an object's type."""
    if obj is None:
        return "null"
    kinds = {bool: "bool", int: "int", float: "real", bytes: "string", Name: "name", list: "array", dict: "dict", Stream: "stream", Ref: "ref"}
    return kinds[type(obj)]


def _stream(data: bytes, at: int, entries: dict, compat: bool) -> tuple[Stream, int]:
    """A stream's bytes: by a direct length, else up to the end marker. ``compat`` skips all
    blanks and comments before them, not one line end."""
    eol = _EOL.match(data, at)
    at = skip_blank(data, at) if compat else eol.end() if eol else at
    length = entries.get("Length")
    if isinstance(length, int) and length >= 0:
        end = at + length
        if end > len(data):
            raise parse_error("stream goes beyond the end of the file", at)
        word, after = token(data, end)
        if word != b"endstream":
            raise parse_error("endstream expected", end)
        return Stream(entries, data[at:end]), after
    if not isinstance(length, Ref):
        raise parse_error("stream without a length", at)
    end = data.find(b"endstream", at)
    if end < 0:
        raise parse_error("endstream not found", at)
    return Stream(entries, data[at:end]), end + len(b"endstream")


def _dict(data: bytes, at: int, compat: bool):
    entries: dict = {}
    while True:
        key, after = token(data, at)
        if key == b">>" and isinstance(key, Word):
            break
        if not isinstance(key, Name):
            raise parse_error("dictionary without an end" if key is None else "dictionary key is not a name", at)
        entries[str(key)], at = value(data, after, compat)
    follows = skip_blank(data, after)
    if follows < len(data) and data[follows : follows + 1].isalpha():
        word, end = token(data, follows)
        if word == b"stream":
            return _stream(data, end, entries, compat)
    return entries, after


def value(data: bytes, at: int, compat: bool = False):
    """The object at ``at`` and its end."""
    t, after = token(data, at)
    if t is None:
        raise parse_error("object expected", at)
    if isinstance(t, Word):
        if t == b"<<":
            return _dict(data, after, compat)
        if t == b"[":
            items = []
            while True:
                closing, end = token(data, after)
                if isinstance(closing, Word) and closing == b"]":
                    return items, end
                if closing is None:
                    raise parse_error("array without an end", after)
                item, after = value(data, after, compat)
                items.append(item)
        if t in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[bytes(t)], after
        raise parse_error(f"unexpected {bytes(t)!r}", at)
    if type(t) is int and t >= 0:
        m = _REFERENCE.match(data, after)
        if m:
            return Ref(t, int(m[1])), m.end()
    return t, after
