"""Content streams to positioned text.

An advance is half the font size a byte; the matrices' scaling is not applied. All
layout thresholds are tuned to that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cmp_to_key
from typing import NamedTuple

import pagesift.functions.text as T
from pagesift.pdf.errors import parse_error
from pagesift.pdf.fonts import Encoding, decode_default
from pagesift.pdf.syntax import Name, hex_bytes, literal_string

_BLANK = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\n]*)*")
_OPERATOR = re.compile(rb"[A-Za-z'\"][A-Za-z*'\"]*")
_NUMBER = re.compile(rb"[+-]?[0-9.]*")
_NAME = re.compile(rb"/([A-Za-z0-9_+.\-]*)")
_DICT_EDGE = re.compile(rb"<<|>>")
_EDGE = re.compile("^[{0}]+|[{0}]+$".format(re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].zfill(4), T.WHITE)))
#: Kerning beyond this many thousandths of the size ends a span (fixed value).
WORD_KERN = 200


class Span(NamedTuple):
    text: str
    x: float
    y: float
    font_size: float
    font_name: str | None


def _operand(data: bytes, at: int):
    """The operand at ``at`` and its end; Ellipsis for what is none."""
    c = data[at : at + 1]
    if c == b"(":
        return literal_string(data, at, open_ended=True)
    if c == b"/":
        m = _NAME.match(data, at)
        return Name(m[1].decode("ascii")), m.end()
    if data[at : at + 2] == b"<<":
        depth, pos = 1, at + 2
        while depth and (edge := _DICT_EDGE.search(data, pos)):
            depth, pos = depth + (1 if edge[0] == b"<<" else -1), edge.end()
        return ..., len(data) if depth else pos
    if c == b"<":
        end = data.find(b">", at)
        end = len(data) if end < 0 else end
        return hex_bytes(re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])), end + 1
    if c == b"[":
        items, at = [], at + 1
        while True:
            at = _BLANK.match(data, at).end()
            if data[at : at + 1] in (b"]", b""):
                return items, at + 1
            item, at = _operand(data, at)
            if item is not ...:
                items.append(item)
    if c in b"+-.0123456789":
        m = _NUMBER.match(data, at)
        try:
            return float(m[0]), m.end()
        except ValueError:
            raise parse_error("invalid number", at) from None
    return ..., at + 1


def operations(data: bytes) -> Iterator[tuple[str, list]]:
    """``(operator, operands)`` in order. A dictionary or a stray byte drops the
    operands before it."""
    at, operands = 0, []
    while True:
        at = _BLANK.match(data, at).end()
        if at >= len(data):
            return
        word = _OPERATOR.match(data, at)
        if word:
            at = word.end()
            yield word[0].decode("ascii"), operands
            operands = []
            continue
        operand, at = _operand(data, at)
        operands = [] if operand is ... else [*operands, operand]


def _numbers(operands: list, n: int) -> list[float] | None:
    """The last ``n`` operands if all are numbers."""
    last = operands[-n:]
    return last if len(last) == n and all(isinstance(v, float) for v in last) else None


class _Text:
    """The text state and the spans shown so far."""

    START = (0.0, 0.0, 0.0, 0.0, 0.0, 12.0, None)

    def __init__(self, encodings: dict[str, Encoding]):
        self.encodings, self.spans, self.saved = encodings, [], []
        self.x, self.y, self.line_x, self.line_y, self.leading, self.size, self.font = self.START

    def save(self):
        self.saved.append((self.x, self.y, self.line_x, self.line_y, self.leading, self.size, self.font))

    def restore(self):
        if self.saved:
            self.x, self.y, self.line_x, self.line_y, self.leading, self.size, self.font = self.saved.pop()

    def to_line(self, x: float, y: float):
        self.x, self.y, self.line_x, self.line_y = x, y, x, y

    def next_line(self):
        self.to_line(self.line_x, self.line_y - self.leading)

    def advance(self, data: bytes):
        self.x += len(data) * self.size * 0.5

    def emit(self, data: bytes, x: float, y: float):
        encoding = self.encodings.get(self.font)
        text = encoding.decode(data) if encoding else decode_default(data)
        if text:
            self.spans.append(Span(_EDGE.sub("", text) or " ", x, y, self.size, self.font))

    def show(self, operands: list):
        if operands and type(operands[-1]) is bytes:
            self.emit(operands[-1], self.x, self.y)
            self.advance(operands[-1])

    def show_kerned(self, items: list):
        held, start = None, (0.0, 0.0)
        for item in items:
            if type(item) is bytes:
                if held is None:
                    held, start = b"", (self.x, self.y)
                held += item
                self.advance(item)
            elif isinstance(item, float):
                if abs(item) > WORD_KERN and held is not None:
                    self.emit(held, *start)
                    held = None
                self.x -= item / 1000.0 * self.size
        if held:
            self.emit(held, *start)

    def run(self, op: str, operands: list):
        match op:
            case "q":
                self.save()
            case "Q":
                self.restore()
            case "BT":
                self.to_line(0.0, 0.0)
            case "Tf" if len(operands) >= 2:
                name, size = operands[-2:]
                self.font = str(name) if isinstance(name, Name) else self.font
                self.size = size if isinstance(size, float) else self.size
            case "TL" if by := _numbers(operands, 1):
                self.leading = by[0]
            case "Td" | "TD" if by := _numbers(operands, 2):
                self.leading = -by[1] if op == "TD" else self.leading
                self.to_line(self.line_x + by[0], self.line_y + by[1])
            case "Tm" if len(matrix := [v for v in operands if isinstance(v, float)]) >= 6:
                self.to_line(matrix[4], matrix[5])
            case "T*":
                self.next_line()
            case "Tj":
                self.show(operands)
            case "TJ" if operands and isinstance(operands[-1], list):
                self.show_kerned(operands[-1])
            case "'" | '"':
                self.next_line()
                self.show(operands)


def raw_spans(data: bytes, encodings: dict[str, Encoding]) -> list[Span]:
    """Every shown text as a span, in order; blank text is one blank."""
    text = _Text(encodings)
    for op, operands in operations(data):
        text.run(op, operands)
    return text.spans


def _before(a: Span, b: Span) -> int:
    """Lines downwards, and rightwards within a line. The tolerance is ``a``'s, so the
    order need not be transitive."""
    if abs(b.y - a.y) > 0.3 * a.font_size:
        return (b.y > a.y) - (b.y < a.y)
    return (a.x > b.x) - (a.x < b.x)


def _joint(head: Span, last: Span, span: Span) -> str | None:
    """What stands between ``last`` and ``span`` in one text; None if they are apart.
    Line, font and width come from the text's ``head``."""
    if abs(span.y - head.y) > 0.3 * head.font_size or span.font_name != head.font_name:
        return None
    width = 0.5 * head.font_size
    gap = span.x - (last.x + len(last.text) * width)
    if len(last.text) <= 1 and len(span.text) <= 1:
        return "" if -3 * width < gap < 3 * width else None
    if -2 * width < gap < 0.8 * width:
        return ""
    return " " if gap < 2 * width else None


def merge_spans(spans: list[Span]) -> list[Span]:
    """Neighbours on a line in one font become one span at the first one's place."""
    groups: list[tuple[Span, list[str]]] = []
    last = None
    for span in sorted(spans, key=cmp_to_key(_before)):
        between = _joint(groups[-1][0], last, span) if groups else None
        if between is None:
            groups.append((span, [span.text]))
        else:
            groups[-1][1].extend((between, span.text))
        last = span
    return [head._replace(text="".join(parts)) for head, parts in groups]


def page_spans(data: bytes, encodings: dict[str, Encoding] | None = None) -> list[Span]:
    return merge_spans(raw_spans(data, encodings or {}))
