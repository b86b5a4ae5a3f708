"""WARC archives as seekable Zstandard bundles, and random access into them.

Records are grouped into frames of about ``FRAME`` bytes that are compressed
independently; a bundle ends with the seek table of the public seekable format: a
skippable frame that lists each frame's compressed and decompressed size. An index maps each record
identifier to (bundle, frame, offset in the frame, length), so one record is read by
decompressing one frame.

Bundles are rows of a written table (``bundle, data, index``), so they live in
whatever store Spark writes to; :func:`export_bundles` puts each into a file of its own.

Payloads that occur several times are stored once: of equal payloads of at least
``min_payload`` bytes the record with the smallest page id is the response, the others
are revisits that refer to it.

Defined cases: null html is an empty payload; null url is written as
``about:blank`` and blanks in a url are percent-encoded; rows that repeat the page
id of a response are responses too (a record can't revisit itself); a null page id
is a revisit if an equal payload has an id, else a response; a payload larger than a frame
is a frame of its own; an empty table gives no bundles and no rows; extra columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import materialize

FRAME, BUNDLE, LEVEL = 1 << 18, 8 << 20, 3
DATE = "2020-01-01T00:00:00Z"
#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = "array<struct<record_id:string,frame:int,offset:long,length:long>>"


def record_id(page_id: int | None) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """``page_id, url, type, refers_to, digest, payload_bytes, payload`` (None for revisits)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda v: None if v is None or v.endswith(":null>") else int(v.rpartition(":")[2][:-1])
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    revisit = fields["warc-type"] == "revisit"
    return {"page_id": page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to")), "digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": size, "payload": None if revisit else payload}


class BundleWriter:
    """Collects records into frames and closes with the seek table."""

    def __init__(self, frame_bytes: int = FRAME, level: int = LEVEL):
        import zstandard

        self.zstd, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open: list[bytes] = []
        self.fill = self.raw = 0

    def add(self, name: str, record: bytes) -> None:
        if self.fill and self.fill + len(record) > self.frame_bytes:
            self._end_frame()
        self.index.append({"record_id": name, "frame": len(self.parts), "offset": self.fill, "length": len(record)})
        self.open.append(record)
        self.fill += len(record)
        self.raw += len(record)

    def _end_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.fill))
            self.open, self.fill = [], 0

    def close(self) -> bytes:
        self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(table)) + table


class BundleReader:
    """Random access: the footer names the frames, a read decompresses one."""

    def __init__(self, data: bytes):
        import zstandard

        count, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table = len(data) - 9 - count * width
        if struct.unpack("<II", data[table - 8 : table]) != (SKIPPABLE, count * width + 9):
            raise ValueError("broken seek table")
        self.data, self.zstd, self.frames, at = data, zstandard.ZstdDecompressor(), [], 0
        for k in range(count):
            packed, raw = struct.unpack_from("<II", data, table + k * width)
            self.frames.append((at, packed, raw))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, raw = self.frames[k]
            self.last = (k, self.zstd.decompress(self.data[at : at + packed], max_output_size=raw))
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def write_bundles(pages: DataFrame, min_payload: int = 0, bundle_bytes: int = BUNDLE, frame_bytes: int = FRAME, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every page; returns the written table ``bundle, data, index``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    # written, so that a payload which many pages share can be split over tasks below
    first = materialize(rows.groupBy("digest").agg(F.min("page_id").alias("first")), "payloads")
    refers = F.when((F.octet_length("html") >= min_payload) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = rows.join(first, "digest").select("page_id", "url", "html", refers.alias("refers_to"))

    def pack(batches):
        from pyspark import TaskContext

        part, made, writer = TaskContext.get().partitionId(), 0, None

        def row(w):
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{made:05d}.warc.zst"]), pa.array([w.close()], pa.binary()), pa.array([w.index], kind)], ["bundle", "data", "index"])

        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for page, url, html, to in zip(*batch.columns, strict=True):
                page = page.as_py()
                writer = writer or BundleWriter(frame_bytes)
                writer.add(record_id(page), write_record(page, url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), to.as_py()))
                if writer.raw >= bundle_bytes:
                    yield row(writer)
                    made, writer = made + 1, None
        if writer:
            yield row(writer)

    return materialize(rows.mapInArrow(pack, f"bundle string, data binary, index {_INDEX}"), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, read through its index entry and checked
    against its digest: ``page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload, bundle, frame, offset``."""

    def unpack(batches):
        for batch in batches:
            for name, data, index in zip(*batch.columns, strict=True):
                reader, some = BundleReader(data.as_py()), []
                for entry in index.as_py():
                    r = parse_record(reader.record(entry["frame"], entry["offset"], entry["length"]))
                    if record_id(r["page_id"]) != entry["record_id"] or r["payload"] is not None and payload_digest(r["payload"]) != r["digest"]:
                        raise ValueError(f"broken record {entry['record_id']} in {name.as_py()}")
                    some.append({**r, **entry})
                    if len(some) >= 1024:
                        yield batch_of(some, name.as_py())
                        some = []
                if some:
                    yield batch_of(some, name.as_py())

    def batch_of(some, name):
        at = lambda key, kind: pa.array([r[key] for r in some], kind)
        return pa.RecordBatch.from_arrays(
            [at("page_id", pa.int64()), at("url", pa.string()), at("type", pa.string()), at("refers_to", pa.int64()), at("payload_bytes", pa.int64()), at("digest", pa.string()), at("payload", pa.binary()), pa.array([name] * len(some)), at("frame", pa.int32()), at("offset", pa.int64())],
            ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "bundle", "frame", "offset"],
        )

    return bundles.select("bundle", "data", "index").mapInArrow(unpack, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, bundle string, frame int, offset long")


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle to ``folder`` (a mounted, shared path); returns the index
    ``record_id, path, frame, offset, length``. A repeated task rewrites the same file."""

    def save(batches):
        import os

        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                path = os.path.join(folder, name.as_py())
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(data.as_py())
                os.replace(f.name, path)
            paths = pa.array([os.path.join(folder, x.as_py()) for x in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([paths, batch.column(2)], ["path", "index"])

    saved = bundles.select("bundle", "data", "index").mapInArrow(save, f"path string, index {_INDEX}")
    return saved.select("path", F.explode("index").alias("e")).select("e.record_id", "path", "e.frame", "e.offset", "e.length")


def archive_digest(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write the archives, read them back, and describe every page."""
    read = read_bundles(write_bundles(pages, min_payload))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset")


ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, n, list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS digest
  FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY digest) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER (PARTITION BY digest) THEN min(page_id) OVER (PARTITION BY digest) END AS refers_to
FROM d
"""
