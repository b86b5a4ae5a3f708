"""Splitting whole texts into the pieces that byte-level BPE merges within, and a
bounded cache of what was computed for a piece. Shared by both BPE operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Characters handed to the pattern at once; very long texts are cut only where a
#: piece must begin, so memory stays bounded and the pieces are the same.
SEGMENT = 1 << 16


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cut before a space that stands between two non-blank characters: a piece
    never runs over such a place, since a blank is only its first character or
    part of a run of blanks."""
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                yield text[at:]
                return
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class PieceCache(dict):
    """``cache[piece]`` computes and keeps a value. Two generations bound the memory:
    when the young one is full it becomes the old one, and what is still asked for
    moves back. Long pieces are computed each time."""

    def __init__(self, compute: Callable[[str], object], entries: int = 150_000, longest: int = 48):
        super().__init__()
        self.compute, self.entries, self.longest, self.old = compute, entries, longest, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.compute(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value
