"""PDF files made from spans, for fixtures and round trips.

``variant`` is a set of: ``stream`` (cross-reference and object streams), ``flate``,
``hex`` (filters; both together apply in sequence), ``tree`` (a nested page tree),
``parts`` (an array of contents), ``length`` (lengths as references), ``update`` (a second
revision with ``/Prev``), ``mac`` and ``cmap`` (font encodings).
"""

from __future__ import annotations

import zlib

from pagesift.functions.text import MACROMAN

VARIANTS = [(), ("flate",), ("stream",), ("stream", "flate"), ("tree", "parts"), ("flate", "hex", "length"), ("update",), ("mac",), ("cmap", "flate")]


def _text(text: str, variant) -> bytes:
    if "cmap" in variant:
        return b"<" + text.encode("utf-16-be", "replace").hex().upper().encode() + b">"
    if "mac" in variant:
        text = text.translate(str.maketrans(MACROMAN[1], MACROMAN[0]))
    return b"(" + text.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def _content(spans: list[dict], variant) -> bytes:
    rows = [b"BT /%s %s Tf %s %s Td %s Tj ET" % (s["font_name"].encode(), f"{s['font_size']:g}".encode(), f"{s['x']:.10g}".encode(), f"{s['y']:.10g}".encode(), _text(s["text"], variant)) for s in spans]
    return b"\n".join(rows)


def _cmap() -> bytes:
    return b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0020> <00FF> <0020> endbfrange"


class _Builder:
    def __init__(self, variant):
        self.variant, self.bodies = variant, {}

    def add(self, body: bytes, number: int | None = None) -> int:
        number = number or len(self.bodies) + 1
        self.bodies[number] = body
        return number

    def stream(self, data: bytes, extra: bytes = b"", plain: bool = False) -> int:
        names = [] if plain else [n for n in ("hex", "flate") if n in self.variant]
        if "flate" in names:
            data = zlib.compress(data)
        if "hex" in names:
            data = data.hex().encode() + b">"
        kinds = b" ".join({"hex": b"/ASCIIHexDecode", "flate": b"/FlateDecode"}[n] for n in names)
        how = b"" if not names else b"/Filter %s" % (kinds if len(names) == 1 else b"[" + kinds + b"]")
        length = b"%d 0 R" % self.add(b"%d" % len(data)) if "length" in self.variant else b"%d" % len(data)
        return self.add(b"<< /Length %s %s %s >>\nstream\n%s\nendstream" % (length, how, extra, data))


def _rows(out: bytearray, numbered: dict[int, bytes], root: int, size: int, prev: int | None) -> None:
    """Objects, a classic table and a trailer appended to ``out``."""
    places = {}
    for number, body in numbered.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at = len(out)
    out += b"xref\n"
    if prev is None:
        out += b"0 1\n0000000000 65535 f \n"
    for number, place in places.items():
        out += b"%d 1\n%010d 00000 n \n" % (number, place)
    before = b"" if prev is None else b"/Prev %d" % prev
    out += b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, before, at)


def _compact(builder: _Builder, root: int) -> bytes:
    """Dictionaries in an object stream, located by a cross-reference stream."""
    plain = {n: b for n, b in builder.bodies.items() if b"\nstream\n" not in b}
    head, bodies = b"", b""
    for n, b in plain.items():
        head += b"%d %d " % (n, len(bodies))
        bodies += b + b" "
    place = {n: (2, len(builder.bodies) + 1, i) for i, n in enumerate(plain)}
    box = builder.stream(head + bodies, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(head)))
    out = bytearray(b"%PDF-1.5\n")
    for n, b in builder.bodies.items():
        if n not in plain:
            place[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    own = len(builder.bodies) + 1
    place[own], place[0] = (1, len(out), 0), (0, 0, 65535)
    assert box in place
    rows = b"".join(bytes([k]) + a.to_bytes(4, "big") + c.to_bytes(2, "big") for _, (k, a, c) in sorted(place.items()))
    size = own + 1
    data = zlib.compress(rows)
    at = len(out)
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Root %d 0 R /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (own, size, root, len(data), data)
    out += b"startxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def write(pages: list[list[dict]], variant=()) -> bytes:
    """One file whose pages show the given spans in order."""
    b = _Builder(variant)
    root, tree = b.add(b""), b.add(b"")
    fonts = sorted({s["font_name"] for p in pages for s in p}) or ["F1"]
    encoding = b"/ToUnicode %d 0 R" % b.stream(_cmap()) if "cmap" in variant else b"/Encoding /%s" % (b"MacRomanEncoding" if "mac" in variant else b"WinAnsiEncoding")
    font = b.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica %s >>" % encoding)
    resources = b.add(b"<< /Font << %s >> >>" % b" ".join(b"/%s %d 0 R" % (f.encode(), font) for f in fonts))
    kids = []
    for spans in pages:
        half = len(spans) // 2 if "parts" in variant else 0
        parts = [_content(spans[:half], variant), _content(spans[half:], variant)] if half else [_content(spans, variant)]
        refs = [b"%d 0 R" % b.stream(p) for p in parts]
        what = refs[0] if len(refs) == 1 else b"[%s]" % b" ".join(refs)
        kids.append(b.add(b"<< /Type /Page /Resources %d 0 R /Contents %s >>" % (resources, what)))
    if "tree" in variant:
        kids = [b.add(b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % k for k in kids[i : i + 2])) for i in range(0, len(kids), 2)]
    b.add(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids)), tree)
    b.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree, root)
    if "stream" in variant:
        return _compact(b, root)
    out, size = bytearray(b"%PDF-1.4\n"), len(b.bodies) + 1
    if "update" not in variant:
        _rows(out, b.bodies, root, size, None)
        return bytes(out)
    # the first revision has no pages; the second replaces the tree's top
    first = b.bodies | {tree: b"<< /Type /Pages /Count 0 /Kids [] >>"}
    _rows(out, first, root, size, None)
    prev = out.rfind(b"xref\n", 0, out.rfind(b"startxref"))
    _rows(out, {tree: b.bodies[tree]}, root, size, prev)
    return bytes(out)
