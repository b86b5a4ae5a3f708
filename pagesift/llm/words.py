"""Words of whole texts for the importance weights and the lexical search: runs of
ASCII letters and digits and of every byte past ASCII, with only A-Z lower-cased."""

from __future__ import annotations

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower case for A-Z, a blank for what is no part of a word.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text in order; null has none."""
    return text.translate(_TO_WORDS).split() if text else []
