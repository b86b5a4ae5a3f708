"""Stream filters."""

from __future__ import annotations

import re
import zlib

from pagesift.pdf.errors import PdfError, parse_error, structure
from pagesift.pdf.syntax import Name, hex_bytes


def flate(data: bytes) -> bytes:
    z = zlib.decompressobj()
    try:
        out = z.decompress(data) + z.flush()
    except zlib.error as e:
        raise PdfError("DecompressError", str(e)) from None
    if not z.eof:
        raise PdfError("DecompressError", "incomplete stream")
    return out


def ascii_hex(data: bytes, compat: bool = False) -> bytes:
    """An odd last digit is padded; in ``compat`` it is an error before the end mark."""
    digits = re.sub(rb"[\t\n\f\r ]", b"", data.split(b">", 1)[0])
    if compat and len(digits) % 2 and b">" in data:
        raise parse_error("invalid hexadecimal digit", len(digits))
    bad = re.search(rb"[^0-9A-Fa-f]", digits)
    if bad:
        raise parse_error("invalid hexadecimal digit", bad.start())
    return hex_bytes(digits)


def _paeth(a: int, b: int, c: int) -> int:
    return min((a, b, c), key=lambda v: abs(a + b - c - v))


def unpredict(data: bytes, parms: dict) -> bytes:
    """Undo what coded each row: differences to the left (2) or PNG filters (10 and up)."""
    kind, colors, depth, columns = (parms.get(k, d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if not all(type(n) is int and n > 0 for n in (kind, colors, depth, columns)):
        raise structure("a predictor's parameter is not a positive number")
    if kind == 1:
        return data
    bits = colors * depth
    width, step = (bits * columns + 7) // 8, max(1, bits // 8)
    if kind == 2:
        if depth != 8:
            raise PdfError("UnsupportedFilter", f"predictor 2 of {depth} bits")
        rows = bytearray(data)
        for at in range(0, len(rows), width):
            for i in range(at + step, min(at + width, len(rows))):
                rows[i] = (rows[i] + rows[i - step]) & 255
        return bytes(rows)
    if kind < 10:
        raise PdfError("UnsupportedFilter", f"predictor {kind}")
    above, out = bytes(width), bytearray()
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width if kind else 0):
            left, corner = (row[i - step], above[i - step]) if i >= step else (0, 0)
            guess = {1: left, 2: above[i], 3: (left + above[i]) // 2}.get(kind)
            row[i] = (row[i] + (_paeth(left, above[i], corner) if guess is None else guess)) & 255
        out += row
        above = bytes(row)
    return bytes(out)


FILTERS = {"FlateDecode": flate, "ASCIIHexDecode": ascii_hex}


def decode_stream(entries: dict, data: bytes, compat: bool = False) -> bytes:
    """``data`` through the stream's filters, left to right."""
    names, parms = entries.get("Filter"), entries.get("DecodeParms")
    if names is None:
        return data
    if isinstance(names, Name):
        names, parms = [names], [parms]
    if not isinstance(names, list) or not all(isinstance(n, Name) for n in names):
        raise structure("a filter is not a name")
    parms = parms if isinstance(parms, list) else [parms]
    for i, name in enumerate(names):
        if name not in FILTERS:
            raise PdfError("UnsupportedFilter", str(name))
        data = ascii_hex(data, compat) if name == "ASCIIHexDecode" else FILTERS[name](data)
        if name == "FlateDecode" and i < len(parms) and isinstance(parms[i], dict):
            data = unpredict(data, parms[i])
    return data
