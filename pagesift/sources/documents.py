"""``df.write.format("documents")``: one UTF-8 file for each row ``doc_id, body``.

Files appear only when the whole write is done. A task writes into a folder of its own under
``_temporary``; what failed or was tried twice stays there and goes at the end. The commit moves the
folders of the tasks that count (one move a task, not one a file) next to each other, removes what was there before if
the mode is ``overwrite``, and writes ``_SUCCESS``. An aborted write leaves the folder as it was.

Options: ``path`` (local or a URI that driver and executors reach) and ``extension`` (``txt``). A file's name is the last
part of the id and a digest of the whole id; rows that share an id within a task get numbers.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pagesift.sources.datasource import store
from pagesift.sources.workers import share_package

TEMPORARY, DONE = "_temporary", "_SUCCESS"
#: Seconds without a new file after which no task of an aborted write is taken to run.
QUIET = 1.0


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task that counts, under the write's temporary folder."""

    folder: str
    files: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.extension, self.overwrite = options.get("path"), options.get("extension", "txt"), overwrite
        if not self.path:
            raise ValueError("option path is missing")
        self.write_id = uuid.uuid4().hex[:12]

    def _folder(self, root: str) -> str:
        return f"{root}/{TEMPORARY}/{self.write_id}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        where, root = store(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.write_id}-{task.taskAttemptId()}"
        folder, used, files = f"{self._folder(root)}/{name}", {}, 0
        for batch in iterator:
            ids, bodies = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "body"))
            for doc, body in zip(ids.cast(pa.string()), bodies.cast(pa.string()), strict=True):
                doc, body = doc.as_py() or "", body.as_py() or ""
                if not files:
                    where.create_dir(folder, recursive=True)
                stem = re.sub(r"[^\w.-]", "_", doc.rsplit("/", 1)[-1]).removesuffix(".pdf")
                stem = f"{stem[:80]}-{hashlib.sha1(doc.encode()).hexdigest()[:10]}"
                used[stem] = used.get(stem, 0) + 1
                again = "" if used[stem] == 1 else f"-{used[stem]}"
                with where.open_output_stream(f"{folder}/{stem}{again}.{self.extension}") as out:
                    out.write(body.encode())
                files += 1
        return Written(name, files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        where, root = store(self.path)
        where.create_dir(root, recursive=True)
        old = [f for f in where.get_file_info(fs.FileSelector(root)) if f.base_name != TEMPORARY]
        for m in messages:
            if m is not None and m.files:
                where.move(f"{self._folder(root)}/{m.folder}", f"{root}/{m.folder}")
        for f in old if self.overwrite else []:
            where.delete_dir(f.path) if f.type == fs.FileType.Directory else where.delete_file(f.path)
        self._clear(where, root)
        with where.open_output_stream(f"{root}/{DONE}") as out:
            out.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        """Tasks of an aborted write may run on for a moment and write again what was cleared: it is cleared until
        nothing has come for ``QUIET`` seconds, or for ``QUIET`` * 20 in all."""
        where, root = store(self.path)
        end, still = time.monotonic() + QUIET * 20, 0
        while still < 5 and time.monotonic() < end:
            try:
                still = 0 if self._clear(where, root) else still + 1
            except OSError:  # a file came while its folder was deleted
                still = 0
            time.sleep(QUIET / 5)

    def _clear(self, where, root: str) -> bool:
        """Whether there was something to clear."""
        from pyarrow import fs

        found = where.get_file_info(self._folder(root)).type != fs.FileType.NotFound
        if found:
            where.delete_dir(self._folder(root))
        temporary = f"{root}/{TEMPORARY}"
        if where.get_file_info(temporary).type != fs.FileType.NotFound and not where.get_file_info(fs.FileSelector(temporary)):
            where.delete_dir(temporary)
        return found


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "doc_id string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``df.write.format("documents")`` known."""
    share_package(spark)
    spark.dataSource.register(Documents)
