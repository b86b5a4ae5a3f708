"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece form a doubly linked list; a heap holds the adjacent pairs
that some merge joins, lowest rank first and leftmost among equals. Popping,
merging and pushing the two new neighbours until the heap is empty leaves
``initial symbols - merges`` tokens, so no identifier list is ever built.

The vocabulary is read from a byte-level ``.json`` file of the *tokenizers*
library: its merges and its added special tokens (found inside texts and counted as
one token each, the library's default). The splitting pattern is an argument.

Defined cases: null text counts as empty (0 bytes, 0 tokens); a text of any length is split
in segments that end where a piece must, and counted whole; a null id is passed on and
repeated rows are counted each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.pieces import PieceCache, segments

LIMIT = 1024


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files:
    printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    own = set(plain)
    return [chr(b if b in own else next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of a text; one per worker process."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[s] for s in byte_symbols()]
        self.joins: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.joins.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        special = [t["content"] for t in spec.get("added_tokens", ()) if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(pattern).findall
        self.cache = PieceCache(self.piece)

    def piece(self, piece: str) -> int:
        data = piece.encode("utf-8", "surrogatepass")
        n = len(data)
        if n < 2:
            return n
        joins = self.joins
        symbol = [self.first[b] for b in data]
        heap = []
        for i in range(n - 1):
            join = joins.get(symbol[i] << 32 | symbol[i + 1])
            if join is not None:
                heap.append((join[0], i, symbol[i], symbol[i + 1], join[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            merges += 1
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                join = joins.get(made << 32 | symbol[k])
                if join is not None:
                    heapq.heappush(heap, (join[0], i, made, symbol[k], join[1]))
            h = before[i]
            if h >= 0:
                join = joins.get(symbol[h] << 32 | made)
                if join is not None:
                    heapq.heappush(heap, (join[0], h, symbol[h], made, join[1]))
        return n - merges

    def _plain(self, text: str) -> int:
        get, find = self.cache.__getitem__, self.find
        return sum(sum(map(get, find(part))) for part in segments(text))

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)


@lru_cache(maxsize=2)
def _counter(path: str, pattern: str) -> MergeCounter:
    return MergeCounter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row. ``path`` is where each
    executor finds the vocabulary file."""

    def count(batches):
        counter = _counter(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            out = [counter.count(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
