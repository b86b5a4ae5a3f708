"""PDF files as DataFrames: pages of spans, file facts, cross-references and tokens.

Reading a file is a sequential job of its bytes, so it runs in Python, one task for
many files; everything after the spans is expressions in the JVM. Files never meet,
hence nothing shuffles, and output leaves page by page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from pagesift.pdf.errors import PdfError
from pagesift.schema import ERROR, PAGES, SPAN
from pagesift.sources.workers import share_package

PERMISSIVE, FAILFAST, DROPMALFORMED = "PERMISSIVE", "FAILFAST", "DROPMALFORMED"

_SPAN = pa.struct([("ord", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("font_size", pa.float64()), ("font_name", pa.string())])
_ERROR = pa.struct([("class", pa.string()), ("message", pa.string()), ("position", pa.int64()), ("stage", pa.string())])
#: The Arrow form of the pages.
ARROW_PAGES = pa.schema([("doc_id", pa.string()), ("page_no", pa.int32()), ("spans", pa.list_(_SPAN)), ("error", _ERROR)])
#: Spans after which a batch of pages is handed on, which bounds a task's memory.
BATCH_SPANS = 10_000
#: What every character map that maps anything contains.
MAP_MARK = b"beginbf"


def _guarded(work, stage: str):
    """What ``work`` returns and None, or None and an error row. Whatever a malformed file
    does, it is an error of that file and never of the job."""
    try:
        return work(), None
    except PdfError as e:
        return None, e.row(stage)
    except RecursionError:
        return None, PdfError("Parse", "objects nested too deeply").row(stage)
    except (TypeError, ValueError, KeyError, IndexError, AttributeError, OverflowError, MemoryError) as e:
        return None, PdfError("InvalidStructure", f"{type(e).__name__}: {e}").row(stage)


def parse_pages(content: bytes | None, page_no: int | None = None, compat: bool = False, share: tuple[int, int] = (0, 1)) -> Iterator[tuple[int | None, list[dict] | None, dict | None]]:
    """``(page_no, spans, error)`` of each page. A file that can't be read is one row with
    neither page number nor spans; a bad page has an error and no spans. Of one asked-for
    page only its own objects are read. ``share`` ``(i, n)`` gives the i-th of n equal ranges of
    pages; an unreadable file is in the first."""
    from pagesift.pdf.file import PdfFile

    file, error = _guarded(lambda: PdfFile(content or b"", compat), "parse")
    if error is None:
        found, error = _guarded(lambda: len(file.pages), "pages")
    if error is None and page_no is not None:
        _, error = _guarded(lambda: file.page(page_no), "page")
    if error is not None:
        if share[0] == 0:
            yield None, None, error
        return
    own = range(found * share[0] // share[1], found * (share[0] + 1) // share[1])
    for number in own if page_no is None else [page_no] if page_no in own else []:
        spans, error = _guarded(lambda: [{"ord": i, **s._asdict()} for i, s in enumerate(file.page_spans(number))], "page")  # noqa: B023
        yield number, spans, error


def _reader(page_no: int | None, mode: str, compat: bool):
    def read(batches):
        held, size = [], 0
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for number, spans, error in parse_pages(body.as_py(), page_no, compat):
                    if error and mode == FAILFAST:
                        raise ValueError(f"{doc}, page {number}: {error['class']} {error['message']}")
                    if error and mode == DROPMALFORMED:
                        continue
                    held.append({"doc_id": doc, "page_no": number, "spans": spans, "error": error})
                    size += len(spans or ())
                    if size >= BATCH_SPANS:
                        yield pa.RecordBatch.from_pylist(held, ARROW_PAGES)
                        held, size = [], 0
            batch = body = None  # not held while the next one is read
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW_PAGES)

    return read


def pages(files: DataFrame, id_col: str = "path", content_col: str = "content", page_no: int | None = None, mode: str = PERMISSIVE, compat: bool = False) -> DataFrame:
    """``doc_id, page_no, spans, error`` of files given as bytes; batch or stream.

    ``mode``: PERMISSIVE keeps errors as values, FAILFAST fails on the first,
    DROPMALFORMED leaves pages with errors out. Null content is a file without a header.
    ``compat`` reads malformed files as :class:`pagesift.pdf.file.PdfFile` says.
    """
    if mode not in (PERMISSIVE, FAILFAST, DROPMALFORMED):
        raise ValueError(f"unknown mode {mode!r}")
    share_package(files.sparkSession)
    rows = files.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInArrow(_reader(page_no, mode, compat), PAGES)


def scan_files(spark: SparkSession, path: str, glob: str = "*.pdf", max_bytes: int | None = None) -> DataFrame:
    """Files under ``path`` as ``path, modificationTime, length, content``; ``max_bytes``
    is pushed to the scan, so larger files are never loaded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files if max_bytes is None else files.where(F.col("length") <= max_bytes)


def read_pdfs(spark: SparkSession, path: str, page_no: int | None = None, mode: str = PERMISSIVE, compat: bool = False, **scan) -> DataFrame:
    return pages(scan_files(spark, path, **scan), page_no=page_no, mode=mode, compat=compat)


@udtf(returnType=f"page_no int, spans array<{SPAN}>, error {ERROR}")
class PdfPages:
    """SQL: ``LATERAL pdf_pages(content)``."""

    def eval(self, content: bytes):
        yield from parse_pages(content)


@udtf(returnType=f"page_no int, ord int, text string, x double, y double, font_size double, font_name string, error {ERROR}")
class PdfSpans:
    """SQL: ``LATERAL pdf_spans(content)``; a row a span, or a row an error."""

    def eval(self, content: bytes):
        for number, spans, error in parse_pages(content):
            if error:
                yield number, None, None, None, None, None, None, error
            for s in spans or ():
                yield number, s["ord"], s["text"], s["x"], s["y"], s["font_size"], s["font_name"], None


@udtf(returnType=f"object_count bigint, page_count bigint, root string, error {ERROR}")
class PdfInfo:
    def eval(self, content: bytes):
        from pagesift.pdf.file import PdfFile

        def facts():
            file = PdfFile(content or b"")
            root = file.trailer.get("Root")
            return file.object_count, len(file.pages), f"{root.number} {root.generation} R"

        found, error = _guarded(facts, "parse")
        yield *(found or (None, None, None)), error


@udtf(returnType="obj_num bigint, offset bigint, generation int, in_use boolean, compressed boolean")
class PdfXref:
    """The newest entry of every object number; none for an unreadable file."""

    def eval(self, content: bytes):
        from pagesift.pdf.file import PdfFile

        for number, e in _guarded(lambda: sorted(PdfFile(content or b"").xref.items()), "parse")[0] or ():
            yield number, e.offset, e.generation, e.in_use, e.compressed


@udtf(returnType=f"obj_num bigint, generation int, kind string, keys array<string>, error {ERROR}")
class PdfObjects:
    """Every object in use: its type and, of a dictionary or stream, its sorted keys."""

    def eval(self, content: bytes):
        from pagesift.pdf.file import PdfFile
        from pagesift.pdf.syntax import Ref, as_dict, kind_of

        file, error = _guarded(lambda: PdfFile(content or b""), "parse")
        if error:
            yield None, None, None, None, error
            return
        for number, e in sorted(file.xref.items()):
            if e.in_use:
                found, error = _guarded(lambda: (kind_of(o := file.resolve(Ref(number, e.generation))), sorted(as_dict(o) or ())), "object")  # noqa: B023
                yield number, None if e.compressed else e.generation, *(found or (None, None)), error


@udtf(returnType=f"page_no int, name string, encoding string, mapped int, error {ERROR}")
class PdfFonts:
    """The fonts of every page by resource name: a code page, or how many codes are mapped."""

    def eval(self, content: bytes):
        from pagesift.pdf.file import PdfFile

        pages, error = _guarded(lambda: (f := PdfFile(content or b"")) and [(f, p) for p in f.pages], "parse")
        if error:
            yield None, None, None, None, error
        for number, (file, page) in enumerate(pages or ()):
            listed, error = _guarded(lambda: sorted(file.page_fonts(page).items()), "page")  # noqa: B023
            if error:
                yield number, None, None, None, error
            for name, font in listed or ():
                yield number, name, "map" if font.cids else "table", len(font.cids) or None, None


@udtf(returnType=f"ord int, kind string, value string, position bigint, error {ERROR}")
class PdfTokens:
    """Tokens of object syntax; ends with an error row at what is none."""

    def eval(self, content: bytes):
        from pagesift.pdf.syntax import tokens

        found = []
        _, error = _guarded(lambda: found.extend(tokens(content or b"")), "object")
        for i, (kind, value, at) in enumerate(found):
            yield i, kind, value, at, None
        if error:
            yield len(found), None, None, None, error


@udtf(returnType=f"ord int, text string, x double, y double, font_size double, font_name string, error {ERROR}")
class ContentSpans:
    """Spans of one content stream without fonts, before merging."""

    def eval(self, content: bytes):
        from pagesift.pdf.content import raw_spans

        spans, error = _guarded(lambda: raw_spans(content or b"", {}), "page")
        for i, s in enumerate(spans or ()):
            yield i, *s, None
        if error:
            yield None, None, None, None, None, None, error


def register(spark: SparkSession) -> None:
    """The table functions ``pdf_pages``, ``pdf_spans``, ``pdf_info``, ``pdf_xref``,
    ``pdf_objects``, ``pdf_fonts``, ``pdf_tokens``, ``content_spans`` and the function ``flate_decode`` for SQL."""
    share_package(spark)
    for name, f in {"pdf_pages": PdfPages, "pdf_spans": PdfSpans, "pdf_info": PdfInfo, "pdf_xref": PdfXref, "pdf_objects": PdfObjects, "pdf_fonts": PdfFonts, "pdf_tokens": PdfTokens, "content_spans": ContentSpans}.items():
        spark.udtf.register(name, f)
    spark.udf.register("flate_decode", flate_decode())


def flate_decode():
    """zlib inflate; null where the bytes can't be inflated."""
    @F.arrow_udf("binary")
    def flate_decode(data: pa.Array) -> pa.Array:
        return pa.array((_undone(b.as_py(), ["FlateDecode"]) for b in data), pa.binary())

    return flate_decode


def undo_filters():
    """A stream's bytes through its filters (``FlateDecode`` and ``ASCIIHexDecode`` or their short names) in
    order; null where they can't be undone."""
    @F.arrow_udf("binary")
    def undo_filters(data: pa.Array, filters: pa.Array) -> pa.Array:
        return pa.array((_undone(b.as_py(), f.as_py()) for b, f in zip(data, filters, strict=True)), pa.binary())

    return undo_filters


def pack_streams():
    """A stream's bytes through its filters like :func:`undo_filters`, as ``data`` if they are ``kept`` or may be a character
    map, else deflated as ``packed``: what is written and shuffled of page contents is small."""
    @F.arrow_udf("struct<data: binary, packed: binary>")
    def pack_streams(data: pa.Array, filters: pa.Array, kept: pa.Array) -> pa.Array:
        import zlib

        plain, packed = [], []
        for b, f, k in zip(data, filters, kept, strict=True):
            b = _undone(b.as_py(), f.as_py())
            whole = b is not None and (k.as_py() or MAP_MARK in b)
            plain.append(b if whole else None)
            packed.append(None if b is None or whole else zlib.compress(b, 1))
        return pa.StructArray.from_arrays([pa.array(plain, pa.binary()), pa.array(packed, pa.binary())], ["data", "packed"])

    return pack_streams


def join_streams():
    """``array<struct<data, packed, end>>`` to bytes: of each part its data, inflated if packed, and its end; nothing of a part
    without either."""
    @F.arrow_udf("binary")
    def join_streams(pages: pa.Array) -> pa.Array:
        import zlib

        def part(p: dict) -> bytes:
            data = zlib.decompress(p["packed"]) if p["data"] is None and p["packed"] is not None else p["data"]
            return b"" if data is None else data + p["end"].encode()

        return pa.array((b"".join(map(part, parts.as_py() or ())) for parts in pages), pa.binary())

    return join_streams


def _undone(data: bytes | None, names: list[str | None] | None) -> bytes | None:
    from pagesift.pdf.filters import FILTERS

    known = FILTERS | {"Fl": FILTERS["FlateDecode"], "AHx": FILTERS["ASCIIHexDecode"]}
    try:
        for name in names or ():
            if data is not None and name:
                data = known[name](data) if name in known else None
    except PdfError:
        return None
    return data


def write_documents(bodies: DataFrame, folder: str, extension: str) -> DataFrame:
    """Write one UTF-8 file per document (``doc_id, body``) into ``folder``, a path or URI
    that executors reach. Returns ``doc_id, file``, lazily: the files are written as the
    result is read. Names come from the id's last part and a digest of the whole id; a task
    that is run again writes the same files again."""

    def write(batches):
        import hashlib
        import re

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            files = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stem = re.sub(r"[^\w.-]", "_", (doc or "").rsplit("/", 1)[-1]).removesuffix(".pdf")
                files.append(f"{root}/{stem}-{hashlib.sha1((doc or '').encode()).hexdigest()[:10]}.{extension}")
                with where.open_output_stream(files[-1]) as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], ["doc_id", "file"])

    return bodies.select(F.col("doc_id").cast("string"), F.col("body").cast("string")).mapInArrow(write, "doc_id string, file string")
