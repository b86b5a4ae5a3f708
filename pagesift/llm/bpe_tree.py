"""Byte-level BPE encoding as a monoid reduction over halves, and its decoding.

``encode(a + b)`` differs from ``encode(a) + encode(b)`` only near the seam. A token
sequence is the BPE encoding of its bytes if and only if each two neighbours are
the encoding of their own bytes joined. So two encoded halves are joined by
re-encoding a window of tokens around the seam and growing it until the pairs at
both of its edges are stable; all other pairs were stable before. The join is
associative, so halves are encoded recursively. Windows are a few tokens in prose; in a
long run of one sign no place is stable, and they grow to whole halves. Long windows merge by a heap, so
even such a piece takes little more than linear time.

Decoding concatenates the tokens' bytes up the same tree.

Defined cases: null text counts as empty (no ids; both digests are those of no
bytes); a text of any length is split in segments that end where a piece must; a null id
is passed on and repeated rows are encoded each; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.pieces import PieceCache, segments

LEAF = 6  # bytes; below this the merges are applied directly
#: Bytes from which the next merge is found in a heap and not by looking at all pairs.
HEAP = 96


class TreeCodec:
    """Encoder and decoder of one rank file; one per worker process."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.find = regex.compile(pattern).findall
        self.cache = PieceCache(self._packed)
        self.leaves: dict[bytes, list[int]] = {}
        self.stable: dict[int, bool] = {}

    def direct(self, data: bytes) -> list[int]:
        """Repeatedly merge the adjacent pair of lowest rank, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) >= HEAP:
            return self._heaped(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        scores = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(scores):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _heaped(self, data: bytes) -> list[int]:
        """The same by a heap of pairs and linked parts."""
        ranks, n = self.ranks, len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, m, k = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or len(parts[i]) != m or j >= n or len(parts[j]) != k:
                continue  # one of the two has grown since
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]), len(parts[b])))
        return [ranks[p] for p in parts if p is not None]

    def leaf(self, data: bytes) -> list[int]:
        ids = self.leaves.get(data)
        if ids is None:
            if len(self.leaves) > 100_000:
                self.leaves.clear()
            ids = self.leaves[data] = self.direct(data)
        return ids

    def settled(self, a: int, b: int) -> bool:
        """Whether tokens ``a, b`` are the encoding of their own bytes joined."""
        key = a << 32 | b
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > 200_000:
                self.stable.clear()
            known = self.stable[key] = self.direct(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        if self.settled(left[-1], right[0]):
            return left + right
        i, j, grow = 1, 1, 1
        while True:
            window = self.direct(b"".join([self.bytes_of[t] for t in left[len(left) - i :] + right[:j]]))
            low = i == len(left) or self.settled(left[-i - 1], window[0])
            high = j == len(right) or self.settled(window[-1], right[j])
            if low and high:
                return left[: len(left) - i] + window + right[j:]
            grow *= 2
            if not low:
                i = min(len(left), i + grow)
            if not high:
                j = min(len(right), j + grow)

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece, its halves first."""
        if len(data) <= LEAF:
            return self.leaf(data)
        middle = len(data) // 2
        return self.join(self.encode_bytes(data[:middle]), self.encode_bytes(data[middle:]))

    def _packed(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.encode_bytes(data)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        get, find = self.cache.__getitem__, self.find
        return b"".join([b"".join(map(get, find(part))) for part in segments(text)])

    def decode(self, packed: bytes, width: int = 1 << 15) -> bytes:
        """The bytes of packed ids; halves are decoded and concatenated."""
        if len(packed) <= 4 * width:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        middle = len(packed) // 8 * 4
        return self.decode(packed[:middle]) + self.decode(packed[middle:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TreeCodec:
    return TreeCodec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids (array of int)`` for every row: the operator's real output."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(c.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                packed = c.encode(t.as_py() or "")
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
