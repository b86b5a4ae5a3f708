"""Approximate nearest neighbours with balanced posting lists.

Nearness is the largest inner product. Vectors are lifted to one length by a further
component (``sqrt(M^2 - |v|^2)``, ``M`` the greatest length), so that the largest inner
product is the smallest distance whatever the lengths are. Centroids come from a balanced
k-means on a bounded sample; every vector goes to its nearest list and, if it lies near a
boundary, to the few others whose distance is within ``closure`` times the nearest
(replication). Centroids are searched by a neighbour graph held in memory (best-first
walks, a batch of walks at once); a query reads the lists whose centroid is within
``ratio`` times its nearest one, at most ``probes``. Both bounds are measured: the sample's
own neighbours tell how far down the order of lists ``TARGET`` of them lie. Data with
clusters need few lists, data without need a share of all.

There are as many lists as hold ``LIST_ROWS`` vectors each, and beyond about 1.6 million
vectors ``3.2 sqrt(n)``; the sample has ``SAMPLE`` vectors, or 8 a list if that is more.
Centroids and graph (the broadcast) so grow with the root of the data.

Lists are stored as blocks of at most ``BLOCK`` vectors and queries are packed into
blocks of a list, so a list that holds a third of all vectors is many rows of
the join, which adaptive execution splits. A product of matrices finds what can be among
the best; what lies within its rounding error is scored again, exactly. Each task merges
what it finds for a query before it sends it on; the last step ranks, per query, a few rows
of each task. A query that so finds fewer than ``top`` reads all lists.

Scores are inner products in double precision, summed from the first component
to the last, so equal vectors have equal scores and ties go to the smaller id.

Defined cases: null or zero vectors, vectors with null or non-finite components,
and vectors whose length isn't the most frequent one take no part; a row that repeats a ``vec_id`` is
another candidate of that id, reported once with its best score; an empty table, or one
whose vectors all take no part, gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import join_checked, materialize

TOP, SAMPLE, LIST_ROWS, MIN_PROBES = 20, 20_000, 400, 4
REPLICAS, CLOSURE, DEGREE, TARGET = 4, 1.12, 16, 0.98
BLOCK = 1024


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Rows over ``longest`` with the further component, measured from the pole so that
    vectors much shorter than the longest stay apart."""
    x = v / longest
    t = np.minimum((x * x).sum(axis=1), 1.0)
    return np.hstack([x, (-t / (1 + np.sqrt(1 - t)))[:, None]])


@dataclass
class Index:
    centers: np.ndarray  # lifted, from the pole
    graph: np.ndarray  # neighbours of each center

    def __post_init__(self):
        from_origin = self.centers + np.eye(1, self.centers.shape[1], self.centers.shape[1] - 1)
        self.units = from_origin / np.linalg.norm(from_origin, axis=1)[:, None]
        self.squares = (self.centers**2).sum(axis=1)

    def of_vectors(self, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` lists nearest to lifted rows, and their distances."""
        return self._walk(y, (y * y).sum(axis=1), self.centers, self.squares, k)

    def of_queries(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` lists nearest to queries, by angle, and their distances."""
        q = np.hstack([v / np.linalg.norm(v, axis=1)[:, None], np.zeros((len(v), 1))])
        return self._walk(q, np.ones(len(q)), self.units, np.ones(len(self.units)), k)

    def _walk(self, rows_of: np.ndarray, own: np.ndarray, centers: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Centers near each row, nearest first, by walks in the graph: all walks take one
        step at a time."""
        m, n = len(centers), len(rows_of)
        k = min(k, m)
        width = min(m, k + k // 4 + 8)
        out_i, out_d = np.empty((n, k), np.int64), np.empty((n, k))
        seeds = np.unique(np.linspace(0, m - 1, min(m, 16)).astype(int))
        for at in range(0, n, 512):
            x, base = rows_of[at : at + 512], own[at : at + 512]
            rows = np.arange(len(x))
            pool = np.full((len(x), max(width, len(seeds)) + self.graph.shape[1]), -1)
            size = np.full(pool.shape, np.inf)
            pool[:, : len(seeds)] = seeds
            size[:, : len(seeds)] = base[:, None] + squares[seeds] - 2 * (x @ centers[seeds].T)
            seen = np.zeros((len(x), m), bool)
            seen[:, seeds] = True
            walked = np.zeros((len(x), m), bool)
            while True:
                order = np.argsort(size, axis=1, kind="stable")
                pool, size = np.take_along_axis(pool, order, 1), np.take_along_axis(size, order, 1)
                pool[:, width:], size[:, width:] = -1, np.inf
                fresh = (pool >= 0) & ~walked[rows[:, None], np.maximum(pool, 0)]
                go = fresh.any(axis=1)
                if not go.any():
                    break
                r = np.flatnonzero(go)
                here = pool[r, fresh[r].argmax(axis=1)]
                walked[r, here] = True
                near = self.graph[here]
                new = ~seen[r[:, None], near]
                d = base[r, None] + squares[near] - 2 * np.einsum("rd,rkd->rk", x[r], centers[near])
                seen[r[:, None], near] = True
                last = size.shape[1] - near.shape[1]
                pool[r, last:] = np.where(new, near, -1)
                size[r, last:] = np.where(new, d, np.inf)
            out_i[at : at + 512], out_d[at : at + 512] = pool[:, :k], np.sqrt(np.maximum(size[:, :k], 0))
        return out_i, out_d


def _means(x: np.ndarray, m: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Balanced k-means by a size penalty; more than 1,024 means are made group by group."""
    if m > 1024:
        coarse = _means(x, int(np.ceil(np.sqrt(m))), rng, rounds)
        near = _nearest(x, coarse, 0.0)
        sizes = np.bincount(near, minlength=len(coarse))
        parts = np.maximum(1, np.round(m * sizes / len(x))).astype(int)
        return np.vstack([_means(x[near == g], min(parts[g], sizes[g]), rng, rounds) for g in range(len(coarse)) if sizes[g]])
    c = x[rng.choice(len(x), m, replace=False)]
    penalty, spread = np.zeros(m), ((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()
    for _ in range(rounds):
        near = _nearest(x, c, penalty)
        sizes = np.bincount(near, minlength=m)
        penalty += 0.04 * spread * (sizes / (len(x) / m) - 1).clip(-1, 4)
        full = np.flatnonzero(sizes)
        c = x[rng.choice(len(x), m)]  # an empty list starts anew
        c[full] = np.add.reduceat(x[np.argsort(near, kind="stable")], np.cumsum(sizes[full]) - sizes[full], axis=0) / sizes[full, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, penalty) -> np.ndarray:
    weight = (c * c).sum(axis=1) + penalty
    return np.concatenate([(weight - 2 * (x[i : i + 2048] @ c.T)).argmin(axis=1) for i in range(0, len(x), 2048)])


def build(sample: np.ndarray, lists: int, longest: float, seed: int = 0, rounds: int = 12) -> Index:
    """Centers of the sample's vectors, then their neighbour graph."""
    rng = np.random.default_rng(seed)
    y = lifted(sample, longest)
    c = _means(y, max(1, min(lists, len(y))), rng, rounds)
    m = len(c)
    if m == 1:
        return Index(c, np.zeros((1, 1), np.int64))
    degree, square = min(DEGREE, m - 1), (c * c).sum(axis=1)
    near = []
    for at in range(0, m, 1024):
        d = square - 2 * (c[at : at + 1024] @ c.T)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near.append(np.argpartition(d, degree - 1, axis=1)[:, :degree])
    far = rng.integers(0, m, (m, 4))  # a few long edges keep the graph connected
    ring = ((np.arange(m) + 1) % m)[:, None]
    return Index(c, np.hstack([np.vstack(near), far, ring]))


def bounds(index: Index, sample: np.ndarray, longest: float, top: int, closure: float, replicas: int, target: float, queries: int = 256) -> tuple[int, float]:
    """``probes, ratio`` with which the lists read hold ``target`` of the ``top`` neighbours
    that sampled queries have in the sample."""
    asks = np.unique(np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int))
    near, d = index.of_vectors(lifted(sample, longest), min(replicas, len(index.centers)))
    of = np.where(d <= closure * d[:, :1] + 1e-12, near, near[:, :1])
    ranks, ratios = [], []
    for q in asks:
        s = sample @ sample[q]
        s[q] = -np.inf
        best = np.argsort(-s, kind="stable")[: min(top, len(s) - 1)]
        size = np.sqrt(np.maximum(2 - 2 * (index.units[:, :-1] @ (sample[q] / np.linalg.norm(sample[q]))), 0))
        place = np.empty(len(size), int)
        place[np.argsort(size, kind="stable")] = np.arange(len(size))
        first = np.take_along_axis(of[best], place[of[best]].argmin(axis=1)[:, None], 1)[:, 0]
        ranks.append(place[first] + 1)
        ratios.append(size[first] / max(size.min(), 1e-12))
    ranks, ratios = np.concatenate(ranks), np.concatenate(ratios)
    if not len(ranks):
        return MIN_PROBES, 1.0
    return max(MIN_PROBES, int(np.quantile(ranks, target, method="higher"))), float(np.quantile(ratios, (1 + target) / 2, method="higher"))


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, components added in order."""
    out = np.zeros(len(q))
    for a, b in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(v.T), strict=True):
        out += a * b
    return out


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Positions of each query's best rows, repeated (query, vec) pairs once."""
    order = np.lexsort((vec, -score, query))
    q, v = query[order], vec[order]
    # equal pairs have equal scores unless an id repeats; keep the first of each
    pair = np.lexsort((np.arange(len(q)), v, q))
    first = np.ones(len(q), bool)
    first[pair[1:]] = (q[pair[1:]] != q[pair[:-1]]) | (v[pair[1:]] != v[pair[:-1]])
    order, q = order[first], q[first]
    start = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[rank < top]


def _taking_part(batches):
    """Ids, vectors, dimensions and lengths (scaled, so squares don't overflow) of the rows
    that take part."""
    for batch in batches:
        lists = batch.column(1)
        size = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        of, bad = np.repeat(np.arange(len(size)), size), ~np.isfinite(flat)
        most = np.zeros(len(size))
        np.maximum.at(most, of, np.where(bad, 0, np.abs(flat)))
        keep = np.asarray(batch.column(0).is_valid()) & (np.bincount(of, bad, len(size)) == 0) & (most > 0)
        scale = np.where(most > 0, most, 1)
        length = scale * np.sqrt(np.bincount(of, np.where(bad, 0, flat / scale[of]) ** 2, len(size)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(size.astype(np.int32)), pa.array(length)], ["vec_id", "v", "d", "length"]).filter(pa.array(keep))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int, float]:
    """Ids and vectors that take part, their dimension, how many they are and the length
    of the longest."""
    kind = "float" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.mapInArrow(_taking_part, f"vec_id long, v array<{kind}>, d int, length double")
    found = rows.groupBy("d").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, total, longest = found[0] if found else (0, 0, 0.0)
    return rows.where(F.col("d") == dim).select("vec_id", "v"), dim, total, longest


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, every: int = 20, sample_rows: int = SAMPLE, list_rows: int = LIST_ROWS, probes: int | None = None, ratio: float | None = None, closure: float = CLOSURE, replicas: int = REPLICAS, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by
    ``every``, its ``top`` nearest found among all other rows. ``probes`` and ``ratio`` are
    measured on the sample unless given."""
    spark = vectors.sparkSession
    rows, dim, total, longest = usable(vectors, id_col, vec_col)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"  # as given, so nothing is rounded
    lists = int(max(1, min(total // list_rows, 1280 / list_rows * total**0.5)))
    sample_rows = max(sample_rows, 8 * lists)
    share = min(1.0, 1.2 * sample_rows / total)
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000).orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(sample_rows)
    got = some.select("v").toArrow().column(0).combine_chunks()
    sample = np.asarray(got.flatten() if len(got) else [], float).reshape(-1, dim)
    if not len(sample):
        sample = np.asarray([r["v"] for r in rows.limit(sample_rows).collect()], float)
    built = build(sample, lists, longest)
    lists = len(built.centers)
    measured = bounds(built, sample, longest, max(1, round(top * len(sample) / total)), closure, replicas, target)
    probes = min(lists, probes or measured[0])
    ratio = measured[1] if ratio is None else ratio
    index = spark.sparkContext.broadcast(built)

    def packed(to, own, at, asked, v):
        """Blocks of a list, of rows ``at`` of ``v`` with ids ``own``."""
        order = np.lexsort((own, to, asked))
        to, own, at, asked = to[order], own[order], at[order], asked[order]
        cuts = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (asked[1:] != asked[:-1]), [True])))
        cuts = np.unique(np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [cuts[-1:]]))
        raw = v.astype(kind)
        ids = [own[a:b].astype("<i8").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        data = [raw[at[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]], pa.int64()), pa.array(asked[cuts[:-1]], pa.int32()), pa.array(ids, pa.binary()), pa.array(data, pa.binary())], ["list", "asked", "ids", "data"])

    def route(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids, v = batch.column(0).to_numpy(), np.asarray(batch.column(1).flatten(), float).reshape(-1, dim)
            near, d = index.value.of_vectors(lifted(v, longest), min(replicas, lists))
            i, k = np.nonzero(d <= closure * d[:, :1] + 1e-12)
            parts = [(near[i, k], ids[i], i, np.zeros(len(i), np.int32))]
            asks = np.flatnonzero(ids % every == 0)
            if len(asks):
                near, d = index.value.of_queries(v[asks], probes)
                i, k = np.nonzero(d <= ratio * d[:, :1] + 1e-12)
                parts.append((near[i, k], ids[asks[i]], asks[i], np.ones(len(i), np.int32)))
            yield packed(*(np.concatenate(x) for x in zip(*parts, strict=True)), v)

    def ask(batches):
        for batch in batches:
            if len(batch):
                v = np.asarray(batch.column(1).flatten(), float).reshape(-1, dim)
                yield packed(np.zeros(len(v), np.int64), batch.column(0).to_numpy(), np.arange(len(v)), np.ones(len(v), np.int32), v)

    block = "list long, asked int, ids binary, data binary"
    blocks = materialize(rows.mapInArrow(route, block), "postings")
    stored = blocks.where("asked = 0").select("list", F.col("ids").alias("v_ids"), F.col("data").alias("v_data"))
    asked = blocks.where("asked = 1").select("list", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def scan(batches):
        held, rows_held, floors = [], 0, {}

        def flush():
            q, v, s = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = _best(q, v, s, top)
            return q[keep], v[keep], s[keep]

        for batch in batches:
            for q_ids, q_data, v_ids, v_data in zip(*batch.columns, strict=True):
                q, v = np.frombuffer(q_ids.as_buffer(), "<i8"), np.frombuffer(v_ids.as_buffer(), "<i8")
                # rows that repeat an id count once, with their best score, towards the best
                own = np.argsort(v, kind="stable")
                one = np.flatnonzero(np.concatenate(([True], v[own][1:] != v[own][:-1])))
                a, b = np.frombuffer(q_data.as_buffer(), kind).reshape(-1, dim).astype(float), np.frombuffer(v_data.as_buffer(), kind).reshape(-1, dim).astype(float)
                # twice the rounding error of a product, and of the score that follows
                error = 4 * dim * np.finfo(float).eps * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
                for at in range(0, len(q), 256):
                    some = q[at : at + 256]
                    s = a[at : at + 256] @ b.T
                    s[some[:, None] == v[None, :]] = -np.inf
                    floor = np.array([floors.get(x, -np.inf) for x in some.tolist()])
                    if len(one) > top:  # all rows as good as the last of the best, for ties
                        each = np.maximum.reduceat(s[:, own], one, axis=1) if len(one) < len(v) else s
                        mine = np.partition(each, each.shape[1] - top, axis=1)[:, each.shape[1] - top] - error[at : at + 256]
                        better = np.flatnonzero(mine > floor)
                        floor[better] = mine[better]
                        floors.update(zip(some[better].tolist(), mine[better].tolist(), strict=True))
                    i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
                    held.append((some[i], v[j], scores(a[at + i], b[j])))
                    rows_held += len(i)
                if rows_held > 400_000:
                    held = [flush()]
                    rows_held = len(held[0][0])
                    if rows_held > 200_000:  # many queries: hand on what there is
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["query_id", "vec_id", "score"])
                        held, rows_held, floors = [], 0, {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flush()], ["query_id", "vec_id", "score"])

    def ranked(asked: DataFrame) -> DataFrame:
        found = asked.join(stored, "list").select("q_ids", "q_data", "v_ids", "v_data").mapInArrow(scan, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return materialize(found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"), "neighbours")

    out = ranked(asked)
    counted = out.groupBy("query_id").agg(F.count("*").alias("found"))
    whole = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id")).distinct().join(counted, "query_id", "left")
    short = materialize(whole.where(F.coalesce("found", F.lit(0)) < top).select("query_id"), "short-queries")
    if short.take(1) and rows.select("vec_id").distinct().limit(top + 1).count() > 1:
        again = join_checked(rows, short.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_semi")
        again = again.select("vec_id", "v").mapInArrow(ask, block).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))).alias("list"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        out = join_checked(out, short, "query_id", "left_anti").unionByName(ranked(again))
    return out
