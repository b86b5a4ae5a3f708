"""Why a file or page cannot be read."""

from __future__ import annotations


class PdfError(Exception):
    """An error with a class name that becomes a value of ``error.class``."""

    def __init__(self, kind: str, message: str = "", position: int | None = None):
        super().__init__(kind, message, position)
        self.kind, self.message, self.position = kind, message, position

    def row(self, stage: str = "page") -> dict:
        """As ``error`` of a page; ``stage`` is ``parse``, ``pages`` or ``page``."""
        return {"class": self.kind, "message": self.message, "position": self.position, "stage": stage}


#: What each class reads as (fixed values, shown to users).
TEXTS = {
    "MissingHeader": "Invalid PDF: missing %PDF header",
    "MissingEof": "Invalid PDF: missing %%EOF marker",
    "Parse": "Parse error at byte {position}: {message}",
    "InvalidXref": "Invalid xref table",
    "ObjectNotFound": "Object not found: {message}",
    "InvalidStructure": "Invalid document structure: {message}",
    "UnsupportedFilter": "Unsupported filter: {message}",
    "DecompressError": "Decompression failed: {message}",
    "InvalidUtf8": "Invalid UTF-8 in string",
}


def parse_error(message: str, position: int) -> PdfError:
    return PdfError("Parse", message, position)


def structure(message: str) -> PdfError:
    return PdfError("InvalidStructure", message)
