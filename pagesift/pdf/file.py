"""Random access to the objects of one PDF file, and its pages."""

from __future__ import annotations

import re
from functools import cached_property
from typing import NamedTuple

from pagesift.pdf import content, fonts
from pagesift.pdf.errors import PdfError, parse_error, structure
from pagesift.pdf.filters import decode_stream
from pagesift.pdf.syntax import Name, Ref, Stream, Word, skip_blank, token, value

_SECTION = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\f ]+(\d+)[\0\t\f ]*[\r\n]")
_ROW = re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[ ]+(\d{1,5})[ ]+([nf])")
#: The end of a file in which its ``startxref`` is looked for (fixed value).
TAIL = 1024


class Entry(NamedTuple):
    """Where an object is: at ``offset``, or the ``generation``-th of object stream ``offset``."""

    offset: int
    generation: int
    in_use: bool
    compressed: bool


def entries_of(obj) -> dict:
    """The entries of a dictionary or stream; anything else has none."""
    return obj.entries if isinstance(obj, Stream) else obj if isinstance(obj, dict) else {}


class PdfFile:
    """A parsed file. Objects are read when asked for and kept; of the revisions along
    ``/Prev`` the newest entry of an object holds, and the newest trailer.

    ``compat`` reads malformed or unusual files as older readers did: entries of an older
    classic table win, blanks and comments after ``stream`` are skipped, an odd hexadecimal
    digit is an error and a long character map entry is U+0000."""

    def __init__(self, data: bytes, compat: bool = False):
        self.compat = compat
        if not data.startswith(b"%PDF-"):
            raise PdfError("MissingHeader")
        self.data, self.xref, self.trailer = data, {}, None
        self._objects: dict[int, object] = {}
        self._containers: dict[int, tuple[list[tuple[int, int]], bytes, int]] = {}
        at, seen = self._startxref(), set()
        while at is not None:
            if at in seen:
                raise structure("revisions refer to each other")
            seen.add(at)
            trailer = self._revision(at)
            self.trailer = trailer if self.trailer is None else self.trailer
            at = trailer.get("Prev")
            if at is not None and not isinstance(at, int):
                at = None

    def _startxref(self) -> int:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - TAIL))
        if at < 0:
            raise PdfError("MissingEof")
        number, _ = token(self.data, at + 9)
        if type(number) is not int:
            raise parse_error("startxref without a number", at)
        return number

    def _revision(self, at: int) -> dict:
        at = skip_blank(self.data, at)
        return self._table(at + 4) if self.data.startswith(b"xref", at) else self._xref_stream(at)

    def _table(self, at: int) -> dict:
        while True:
            at = skip_blank(self.data, at)
            if at >= len(self.data):
                raise structure("missing trailer")
            if self.data.startswith(b"trailer", at):
                break
            head = _SECTION.match(self.data, at)
            if head is None:
                raise PdfError("InvalidXref", "bad section", at)
            at, first = head.end(), int(head[1])
            for number in range(first, first + int(head[2])):
                row = _ROW.match(self.data, at)
                if row is None:
                    raise PdfError("InvalidXref", "bad entry", at)
                entry = Entry(int(row[1]), int(row[2]), row[3] == b"n", False)
                self.xref[number] = entry if self.compat else self.xref.get(number, entry)
                at = row.end()
        trailer, _ = value(self.data, at + 7, self.compat)
        if not isinstance(trailer, dict):
            raise structure("trailer is not a dictionary")
        return trailer

    def _xref_stream(self, at: int) -> dict:
        for kind in (int, int, Word):
            part, at = token(self.data, at)
            if type(part) is not kind or (kind is Word and part != b"obj"):
                raise structure("no cross-reference at its place")
        obj, _ = value(self.data, at, self.compat)
        if not isinstance(obj, Stream):
            raise structure("cross-reference is not a stream")
        widths = obj.entries.get("W")
        if not isinstance(widths, list) or len(widths) != 3 or not all(type(w) is int and w >= 0 for w in widths):
            raise structure("cross-reference stream without three widths")
        rows = self._decoded(obj)
        ranges = obj.entries.get("Index")
        if ranges is None or ranges == []:
            ranges = [0, obj.entries.get("Size")]
        if not isinstance(ranges, list) or not all(type(n) is int for n in ranges):
            raise structure("cross-reference stream without a size or a list of ranges")
        width, cursor = sum(widths), 0
        for first, count in zip(ranges[::2], ranges[1::2], strict=False):
            for number in range(first, first + count):
                row, cursor = rows[cursor : cursor + width], cursor + width
                if not width or len(row) < width:
                    break
                kind = int.from_bytes(row[: widths[0]]) if widths[0] else 1
                second, third = int.from_bytes(row[widths[0] : widths[0] + widths[1]]), int.from_bytes(row[widths[0] + widths[1] :])
                if kind in (0, 1, 2):
                    self.xref.setdefault(number, Entry(second, third, kind != 0, kind == 2))
        return obj.entries

    def _decoded(self, obj: Stream) -> bytes:
        return decode_stream(obj.entries, obj.data, self.compat)

    @property
    def object_count(self) -> int:
        return sum(e.in_use for e in self.xref.values())

    def resolve(self, ref: Ref):
        """The object of a number; the generation is not compared."""
        number = ref.number
        if number not in self._objects:
            entry = self.xref.get(number)
            if entry is None or not entry.in_use:
                raise PdfError("ObjectNotFound", f"{number} {ref.generation} R")
            self._objects[number] = self._member(entry) if entry.compressed else self._at(number, entry.offset)
        return self._objects[number]

    def get(self, obj):
        """``obj``, or what it refers to."""
        return self.resolve(obj) if isinstance(obj, Ref) else obj

    def _at(self, number: int, offset: int):
        found, at = token(self.data, offset)
        if found != number or type(found) is not int:
            raise parse_error(f"object {number} expected", offset)
        generation, at = token(self.data, at)
        word, after = token(self.data, at)
        if type(generation) is not int or word != b"obj":
            raise parse_error("obj expected", at)
        return value(self.data, after, self.compat)[0]

    def _member(self, entry: Entry):
        """An object of an object stream, which is decoded once."""
        if entry.offset not in self._containers:
            holder = self.xref.get(entry.offset)
            if holder is not None and holder.compressed:
                raise structure("object stream inside an object stream")
            box = self.resolve(Ref(entry.offset, 0))
            if not isinstance(box, Stream):
                raise structure("object stream expected")
            n, first = box.entries.get("N"), box.entries.get("First")
            if type(n) is not int or type(first) is not int:
                raise structure("object stream without N or First")
            inside, at, numbers = self._decoded(box), 0, []
            for _ in range(2 * n):
                number, at = token(inside, at)
                if type(number) is not int:
                    raise structure("bad head of an object stream")
                numbers.append(number)
            self._containers[entry.offset] = list(zip(numbers[::2], numbers[1::2], strict=True)), inside, first
        index, inside, first = self._containers[entry.offset]
        if entry.generation >= len(index):
            raise structure(f"object stream has no object {entry.generation}")
        return value(inside, first + index[entry.generation][1], self.compat)[0]

    def catalog(self):
        root = self.trailer.get("Root")
        if not isinstance(root, Ref):
            raise structure("Root is not a reference")
        return self.resolve(root)

    @cached_property
    def pages(self) -> list:
        """The page tree's leaves in order; kids that aren't references are skipped."""
        top = entries_of(self.catalog()).get("Pages")
        if not isinstance(top, Ref):
            raise structure("catalog without pages")
        out, todo, seen = [], [top], set()
        while todo:
            ref = todo.pop()
            node = self.resolve(ref)
            if not isinstance(node, dict | Stream):
                raise structure("page tree node is not a dictionary")
            entries = entries_of(node)
            kind = entries.get("Type")
            if kind == "Pages":
                if ref.number in seen:
                    raise structure("page tree refers to itself")
                seen.add(ref.number)
                if not isinstance(entries.get("Kids"), list):
                    raise structure("page tree node without kids")
                todo += [k for k in reversed(entries["Kids"]) if isinstance(k, Ref)]
            elif kind == "Page" or "Contents" in entries or "MediaBox" in entries:
                out.append(node)
        return out

    def page(self, number: int):
        if not 0 <= number < len(self.pages):
            raise structure(f"page {number} not found")
        return self.pages[number]

    def stream_data(self, ref: Ref) -> bytes:
        obj = self.resolve(ref)
        if not isinstance(obj, Stream):
            raise structure("stream expected")
        return self._decoded(obj)

    def contents(self, page) -> bytes:
        """A page's content; the parts of an array each end in a line feed."""
        what = entries_of(page).get("Contents")
        if isinstance(what, Ref):
            return self.stream_data(what)
        if isinstance(what, list):
            return b"".join(self.stream_data(r) + b"\n" for r in what if isinstance(r, Ref))
        raise structure("page without contents" if what is None else "invalid contents")

    def encoding(self, font) -> fonts.Encoding:
        """By character map, else by name, else by base name, else Windows."""
        entries = entries_of(font)
        if not entries:
            raise structure("font is not a dictionary")
        if isinstance(entries.get("ToUnicode"), Ref):
            return fonts.Encoding(cids=fonts.parse_tounicode(self.stream_data(entries["ToUnicode"]), self.compat))
        named = entries.get("Encoding")
        return fonts.named(named if isinstance(named, Name) else entries_of(named).get("BaseEncoding"))

    def page_fonts(self, page) -> dict[str, fonts.Encoding]:
        """Encodings by resource name; a font that can't be read is left out."""
        listed = entries_of(self.get(entries_of(self.get(entries_of(page).get("Resources"))).get("Font")))
        out = {}
        for name, font in listed.items():
            try:
                out[name] = self.encoding(self.get(font))
            except PdfError:
                continue
        return out

    def page_spans(self, number: int) -> list[content.Span]:
        """The positioned text of a page, numbered from 0."""
        page = self.page(number)
        return content.page_spans(self.contents(page), self.page_fonts(page))
