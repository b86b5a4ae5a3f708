"""``spark.read.format("pdf")``: a data source of pages, for batches and for streams of files.

``where page_no = n`` reaches the reader (with ``spark.sql.python.filterPushdown.enabled``),
which then reads only that page's objects of each file. A file of more than ``split_bytes`` is read by several
tasks, each of which takes a range of its pages. Options: ``path``, ``glob``, ``mode`` and ``compat`` as for
:func:`pagesift.sources.pdf.pages`, ``partition_bytes``, ``split_bytes``, and for streams ``log`` and
``files_per_batch``.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

from pagesift.schema import PAGES
from pagesift.sources import pdf
from pagesift.sources.workers import share_package


def store(path: str):
    """The file system and the path in it of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    """Files of one task, each with its share of the pages: the i-th of n ranges."""

    def __init__(self, shares: list[tuple[str, int, int]]):
        super().__init__(shares)
        self.shares = shares


class _Pages:
    """What batch and stream readers share: options, listing, dealing files out and reading them."""

    def __init__(self, options: dict):
        self.path, self.glob = options.get("path"), options.get("glob", "*.pdf")
        self.mode, self.compat = options.get("mode", pdf.PERMISSIVE).upper(), options.get("compat", "false").lower() == "true"
        self.bytes, self.split, self.page = int(options.get("partition_bytes", 64 << 20)), int(options.get("split_bytes", 64 << 20)), None
        if not self.path:
            raise ValueError("option path is missing")

    def listed(self) -> list[tuple[str, int]]:
        """Path and size of every file, by path. Names that start with ``_`` are no input."""
        from pyarrow import fs

        where, root = store(self.path)
        one = where.get_file_info(root)
        found = [one] if one.is_file else where.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.path, f.size) for f in found if f.is_file and (one.is_file or fnmatch.fnmatch(f.base_name, self.glob) and not f.base_name.startswith("_")))

    def dealt(self, files: list[tuple[str, int]]) -> list[Files]:
        out, held, size = [], [], 0
        for path, length in files:
            ranges = -(-length // self.split) if length > self.split else 1
            if ranges > 1:
                out += [Files([(path, i, ranges)]) for i in range(ranges)]
                continue
            if held and size + length > self.bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, 0, 1))
            size += length
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.path)
        rows, size = [], 0
        for path, part, parts in partition.shares:
            with where.open_input_stream(path) as f:
                content = f.read()
            for number, spans, error in pdf.parse_pages(content, self.page, self.compat, (part, parts)):
                if self.page is not None and number is None:
                    continue  # no such page: nothing equals it
                if error and self.mode == pdf.FAILFAST:
                    raise ValueError(f"{path}, page {number}: {error['class']} {error['message']}")
                if error and self.mode == pdf.DROPMALFORMED:
                    continue
                rows.append({"doc_id": path, "page_no": number, "spans": spans, "error": error})
                size += len(spans or ())
                if size >= pdf.BATCH_SPANS:
                    yield pa.RecordBatch.from_pylist(rows, pdf.ARROW_PAGES)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pdf.ARROW_PAGES)


class PdfReader(_Pages, DataSourceReader):
    def pushFilters(self, filters):
        """Takes equality with one page number; what it can't take it gives back."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page_no",) and self.page is None and type(f.value) is int:
                self.page = f.value
            else:
                yield f

    def partitions(self):
        return self.dealt(self.listed())


class PdfStreamReader(_Pages, DataSourceStreamReader):
    """Files in the order in which they are seen, each once.

    What a batch takes is settled before it runs: its files are written as a numbered entry of the
    folder ``log`` (by default ``_seen`` under the path), and an offset is the number of an entry. A
    restart reads the same entries again, so a file is in exactly one batch also if it came late or has an old
    date. An entry appears whole, by a rename. The names of all files seen are held on
    the driver, as 8-byte digests. One query writes to a log.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.log = options.get("log") or f"{self.path.rstrip('/')}/_seen"
        self.most = int(options.get("files_per_batch", 1000))
        self.seen, self.entries = set(), 0

    @staticmethod
    def _digest(path: str) -> bytes:
        import hashlib

        return hashlib.blake2b(path.encode(), digest_size=8).digest()

    def _entry(self, number: int) -> list[list]:
        where, root = store(self.log)
        with where.open_input_stream(f"{root}/{number:012d}.json") as f:
            return json.loads(f.read())

    def _catch_up(self) -> None:
        """Take over the entries that are there."""
        from pyarrow import fs

        where, root = store(self.log)
        where.create_dir(root, recursive=True)
        names = [f.base_name for f in where.get_file_info(fs.FileSelector(root))]
        last = max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)
        while self.entries < last:
            self.entries += 1
            self.seen.update(self._digest(path) for path, _ in self._entry(self.entries))

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        self._catch_up()
        fresh = [f for f in self.listed() if self._digest(f[0]) not in self.seen]
        if fresh:
            where, root = store(self.log)
            name = f"{root}/{self.entries + 1:012d}.json"
            with where.open_output_stream(f"{name}.part") as f:
                f.write(json.dumps(fresh[: self.most]).encode())
            where.move(f"{name}.part", name)
            self._catch_up()
        return {"entry": self.entries}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files = [tuple(f) for number in range(start["entry"] + 1, end["entry"] + 1) for f in self._entry(number)]
        return self.dealt(files) if files else []

    def commit(self, end: dict) -> None:
        """Entries stay: they say which files are done."""


class PdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PdfReader:
        return PdfReader(dict(self.options))

    def streamReader(self, schema) -> PdfStreamReader:
        return PdfStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("pdf")`` known, with filters passed down."""
    share_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfDataSource)
