"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: A-Z lower-cased, words split at ASCII blanks, 4-word shingles with
repeats, XXH64 (seed 42) of each; a bit is set if it is set in over half of the
hashes. Links join fingerprints at ``radius`` or fewer differing bits.

Candidates come from the pigeonhole principle: of ``bands`` bit bands at most
``radius`` can differ, so any linked pair agrees on some ``bands - radius`` of
them; one key per such choice. Inside a key the fingerprints are compared bit-sliced:
64 bit planes stored vertically, one lane per fingerprint, distances of a whole
block updated by carry-save counters, and rows abandoned once every lane has
passed the radius. Keys with more than ``chunk`` fingerprints are cut into chunks
whose pairs are separate groups, so no group outgrows a task and no link is lost.
Each group gives a spanning star of its links, never all pairs. The number of bands is
chosen by the number of fingerprints: more bands give more, but longer keys, in which
fewer fingerprints meet by chance. Links are the same whatever it is.

Defined cases: null and wordless texts have fingerprint zero and link like any
other; copies and equal fingerprints are one node; a null ``doc_id`` is carried
but never names a component unless it is alone; a text of any length is hashed in slices;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import connected_components, materialize

RADIUS, CHUNK, SHINGLE = 4, 512, 4
_SLICE = 1 << 15
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        some = zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)
        hashes = np.array([xxh64_intdigest(joined[i:j], 42) for i, j in some], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1)
        out = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _over(counters: list[np.ndarray], passed: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter, or its overflow, is over ``radius``."""
    over, same = passed.copy(), ~np.zeros_like(passed)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            over |= same & counters[k]
            same &= ~counters[k]
    return over


def _count(counters: list[np.ndarray], passed: np.ndarray, diff: np.ndarray) -> None:
    """Carry-save addition of one bit to every lane's counter, in place."""
    for c in counters:
        carry = c & diff
        c ^= diff
        diff = carry
    passed |= diff


def planes(values: np.ndarray) -> np.ndarray:
    """``(64, lanes / 64)`` bit planes; spare lanes are zero."""
    lanes = -len(values) % 64 + len(values)
    bits = np.zeros((lanes, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close_pairs(queries: np.ndarray, stored: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``(query, stored)`` at ``radius`` or fewer differing bits."""
    slices, depth = planes(stored), max(1, radius.bit_length())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 256):
        rows = np.arange(at, min(at + 256, len(queries)))
        masks = np.where(np.unpackbits(queries[rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), _ONES, np.uint64(0))
        counters = [np.zeros((len(rows), slices.shape[1]), np.uint64) for _ in range(depth)]
        passed = np.zeros((len(rows), slices.shape[1]), np.uint64)
        for bit in range(64):
            _count(counters, passed, slices[bit][None, :] ^ masks[:, bit][:, None])
            if bit % 8 == 7:
                over = _over(counters, passed, radius)
                alive = (over != _ONES).any(axis=1)
                if not alive.any():
                    rows = rows[:0]
                    break
                if bit < 63 and alive.sum() * 4 < 3 * len(rows):
                    rows, masks, passed = rows[alive], masks[alive], passed[alive]
                    counters = [c[alive] for c in counters]
        if len(rows):
            near = np.unpackbits((~_over(counters, passed, radius)).view(np.uint8), axis=1, bitorder="little")[:, : len(stored)]
            i, j = np.nonzero(near)
            found.append((rows[i], j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def close_lanes(diffs: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the XORed pairs have ``radius`` or fewer set bits, bit-sliced."""
    slices, depth = planes(diffs), max(1, radius.bit_length())
    counters, passed = [np.zeros(slices.shape[1], np.uint64) for _ in range(depth)], np.zeros(slices.shape[1], np.uint64)
    for bit in range(64):
        _count(counters, passed, slices[bit])
        if bit % 16 == 15 and (_over(counters, passed, radius) == _ONES).all():
            return np.zeros(len(diffs), bool)
    return np.unpackbits((~_over(counters, passed, radius)).view(np.uint8), bitorder="little")[: len(diffs)].astype(bool)


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to its component's smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


_SMALL = 24


def _group_links(group: np.ndarray, fp: np.ndarray, side: np.ndarray, cross: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal ``group``: between the sides where ``cross``."""
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes = np.diff(cuts)
    u, i, j = fp.view(np.uint64), [], []
    small = np.repeat(sizes <= _SMALL, sizes)
    for d in range(1, min(_SMALL, int(sizes.max(initial=1)))):
        k = np.flatnonzero((group[d:] == group[:-d]) & small[d:] & (~cross[d:] | (side[d:] != side[:-d])))
        if len(k):
            k = k[close_lanes(u[k] ^ u[k + d], radius)]
            i.append(k)
            j.append(k + d)
    for lo, hi in ((cuts[k], cuts[k + 1]) for k in np.flatnonzero(sizes > _SMALL)):
        if cross[lo]:
            first, second = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
            x, y = close_pairs(u[first], u[second], radius)
            i.append(first[x])
            j.append(second[y])
        else:
            x, y = close_pairs(u[lo:hi], u[lo:hi], radius)
            i.append(lo + x[x < y])
            j.append(lo + y[x < y])
    if not i:
        return fp[:0], fp[:0]
    return star_forest(fp[np.concatenate(i)], fp[np.concatenate(j)])


def _linker(radius: int, rows: int = 1 << 16):
    """Groups arrive sorted; a batch ends at a group's end, and holds about ``rows``."""

    def link(batches):
        held: list[pa.RecordBatch] = []

        def links(t: pa.Table):
            key = [t.column(k).to_numpy() for k in ("table", "key", "c", "d")]
            new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0))) if len(t) else np.zeros(0, bool)
            a, b = _group_links(np.cumsum(new), t.column("fp").to_numpy(), t.column("side").to_numpy(), key[2] != key[3], radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < rows:
                continue
            t = pa.Table.from_batches(held)
            key = [t.column(k).to_numpy() for k in ("table", "key", "c", "d")]
            last = np.all([k == k[-1] for k in key], axis=0)
            cut = int(np.argmax(last))
            if cut:
                yield links(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return link


def bands_for(fingerprints: int, radius: int = RADIUS) -> int:
    """The bands that cost least: a row for each choice of bands, and the fingerprints that
    meet in a key by chance, of which a chunk is compared in the time of a row."""
    return min(range(radius + 2, radius + 8), key=lambda b: comb(b, radius) * (1 + fingerprints / CHUNK / 2 ** (64 * (b - radius) / b)))


def links(nodes: DataFrame, radius: int = RADIUS, bands: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Spanning links ``a, b`` between the distinct ``fp`` of ``nodes``."""
    bands = bands_for(nodes.count(), radius) if bands is None else bands
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    masks = []
    for chosen in combinations(range(bands), bands - radius):
        mask = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("k.table", "k.key", "fp")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    rows = rows.join(sizes, ["table", "key"]).withColumn("chunks", F.expr(f"(rows + {chunk - 1}) div {chunk}"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")))
    rows = rows.select("table", "key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    rows = rows.select("table", "key", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    at = ["table", "key", "c", "d"]
    return rows.repartition(*at).sortWithinPartitions(*at, "side").mapInArrow(_linker(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bands: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; the component is named
    by its smallest ``doc_id``."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    parts = connected_components(links(nodes, radius, bands, chunk), "simhash")
    placed = nodes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = materialize(placed.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
