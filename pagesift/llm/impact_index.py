"""Ranked lexical search over a bit-sliced impact index.

What a term adds to a document's score (its impact: the term's weight times the saturated
count of its occurrences in a document of that length) is a whole number that depends on the
corpus only. The index cuts documents into blocks of at most ``block_rows`` (and so many
entries), each in the order of its ids, and stores a bitmap of the block's documents for each bit of a term's impacts: only
as many planes as the largest impact has bits, and only those 64-document words in which the
term occurs.

A query adds its terms' bitmaps by carry-save arithmetic: sum and carry are stacks of
planes, and a term costs a handful of bitwise operations on whole stacks however many
documents it is in. One ripple of carries then gives the scores' planes. The best ``k`` of a block
are found by descending them from the most significant: documents that have the bit and are
still in question are taken if they are no more than are wanted, else the others are dropped.
The best of all blocks are merged by rank.

Tables on the way: ``postings`` (a row a document: its terms of the vocabulary and their counts),
``index`` (a row a block and term, and one with the block's ids). The vocabulary is that of the
queries. Queries come in parts of about ``part_pairs`` query terms, each with its own index, so
what a task holds of them is bounded, and so is a block, whatever the corpus or the number of
queries.

Defined cases: null text has no term, and documents without a term count for nothing; texts of any
length are read whole; rows that repeat a ``doc_id`` are documents of their own, and so are rows
without one, which come last among equal scores; the rows of a repeated query id are one query
with the terms of all of them; queries without a term, or whose terms no document has, have no
result; empty tables give no rows; other columns are not read. Ids are whole numbers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import materialize
from pagesift.llm.words import words

#: Saturation of term counts and share of the length in it, as fractions of 1000 and 100.
K1, B = 1000, 50
UNIT = 1_000_000_000
TOP, BLOCK_ROWS, PART_PAIRS = 50, 4096, 400_000
#: A block also ends before it has more entries than this (a single document may).
BLOCK_POSTINGS = 1 << 18
_INDEX = "block long, term int, words binary, planes binary"
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, term``: the distinct terms of each query, cut as those of documents are."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return queries.select(F.col(id_col).cast("long").alias("item"), F.explode(found).alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, counts`` of every document with a term: ``n`` counts all its
    terms, ``terms`` are places in the vocabulary."""
    known = {term.encode(): at for at, term in enumerate(vocabulary)}

    def look(batches):
        for batch in batches:
            ids, n, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words(text.as_py())
                if tokens:
                    found = Counter(known[t] for t in tokens if t in known)
                    ids.append(doc_id)
                    n.append(len(tokens))
                    terms.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(look, "doc_id long, n long, terms array<int>, counts array<int>")


def term_weights(listed: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """The weight of each of the ``size`` terms of a vocabulary, from its document frequency."""
    seen = listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    out = np.zeros(size, np.int64)
    for term, weight in seen.select("term", F.floor(F.lit(1000.0) * F.log(ratio))).collect():  # one row a term of the vocabulary at most
        out[term] = weight
    return out


def _slices(ids: list, n: np.ndarray, lengths: list, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
    """The block's ids in order, and ``term, word numbers, planes`` of each of its terms."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    at = np.repeat(place, lengths)
    m = np.repeat(100 - B + (B * n * n_docs) // n_terms, lengths)
    impact = weights[terms] * ((UNIT * counts) // (K1 * counts + 20 * m))
    kept = np.flatnonzero(impact)
    kept = kept[np.lexsort((at[kept], terms[kept]))]
    terms, at, impact = terms[kept], at[kept], impact[kept].astype(np.uint64)
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    fresh = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (word[1:] != word[:-1])]) if len(terms) else np.zeros(0, np.int64)
    depth = int(impact.max()).bit_length() if len(impact) else 0
    planes = np.zeros((depth, len(fresh)), np.uint64)
    one = np.uint64(1)
    for p in range(depth):
        planes[p] = np.bitwise_or.reduceat(((impact >> np.uint64(p)) & one) << bit, fresh)
    group, word = terms[fresh], word[fresh].astype(np.uint32)
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if len(group) else []
    start, out = 0, []
    for end in ends:
        own = planes[:, start:end]
        out.append((int(group[start]), word[start:end], own[: int(np.flatnonzero(own.any(1))[-1]) + 1]))
        start = end
    return [ids[i] for i in order], out


def build_index(listed: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``block, term, words, planes`` over written ``postings``: ``words`` are numbers of
    64-document words (32 bits each), ``planes`` their bits from the lowest plane up (64 bits a
    word). The row without a term has the block's ids (64 bits each), and in ``words`` a byte for each
    that says whether it is one."""

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        terms = rows["terms"].combine_chunks()
        lengths = np.diff(terms.offsets.to_numpy())
        flat, counts = terms.flatten().to_numpy().astype(np.int64), rows["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        ids, made = _slices(rows["doc_id"].to_pylist(), rows["n"].to_numpy(), lengths, flat, counts, weights, n_docs, n_terms)
        head = (None, np.array([i is not None for i in ids], np.uint8).tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes())
        made = [head, *((t, w.tobytes(), np.ascontiguousarray(p).tobytes()) for t, w, p in made)]
        return pa.RecordBatch.from_arrays([pa.array([number] * len(made), pa.int64()), *(pa.array(c, kind) for c, kind in zip(zip(*made), (pa.int32(), pa.binary(), pa.binary())))], ["block", "term", "words", "planes"])

    def build(batches):
        number, held, rows, entries = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            upto = np.r_[0, np.cumsum(np.diff(batch["terms"].offsets.to_numpy()))]
            start = 0
            while start < batch.num_rows:
                fits = int(np.searchsorted(upto, upto[start] + BLOCK_POSTINGS - entries, "right")) - 1
                end = min(max(fits, start + (not rows)), start + block_rows - rows)
                if end > start:
                    held.append(batch.slice(start, end - start))
                    rows, entries, start = rows + end - start, entries + int(upto[end] - upto[start]), end
                if start < batch.num_rows or rows == block_rows:
                    yield block(pa.Table.from_batches(held), number)
                    number, held, rows, entries = number + 1, [], 0, 0
        if rows:
            yield block(pa.Table.from_batches(held), number)

    return listed.mapInArrow(build, _INDEX)


def add_slices(slices: list[tuple[np.ndarray, np.ndarray]], n_words: int) -> np.ndarray:
    """The planes of the sum of bit-sliced numbers, each given as word numbers and planes."""
    depth = max(p.shape[0] for _, p in slices) + len(slices).bit_length()
    total, carry = np.zeros((depth, n_words), np.uint64), np.zeros((depth, n_words), np.uint64)
    for at, planes in slices:
        p = planes.shape[0]
        every = len(at) == n_words
        s, c = (total, carry) if every else (total[:, at], carry[:, at])
        half = s[:p] ^ c[:p]
        over = np.zeros_like(s)
        over[1 : p + 1] = (s[:p] & c[:p]) | (half & planes)
        over[p + 1 :] = (s[p:] & c[p:])[:-1]
        s[p:] ^= c[p:]
        s[:p] = half ^ planes
        if every:
            carry = over
        else:
            total[:, at], carry[:, at] = s, over
    ripple = np.zeros(n_words, np.uint64)
    for p in range(depth):
        half = total[p] ^ carry[p]
        total[p], ripple = half ^ ripple, (total[p] & carry[p]) | (half & ripple)
    return total


def _positions(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def top_slices(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the ``k`` largest numbers over zero, the largest first and
    earlier positions first among equals."""
    sure, open_ = np.zeros(total.shape[1], np.uint64), np.bitwise_or.reduce(total, axis=0)
    wanted = k
    for plane in total[::-1]:
        having = open_ & plane
        n = int(np.bitwise_count(having).sum())
        if n > wanted:
            open_ = having
        else:
            sure |= having
            wanted -= n
            open_ &= plane ^ _FULL
            if not wanted:
                break
    at = np.r_[_positions(sure), _positions(open_)[:wanted]]
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    value = np.zeros(len(at), np.int64)
    for p, plane in enumerate(total):
        value += ((plane[word] >> bit) & np.uint64(1)).astype(np.int64) << p
    order = np.lexsort((at, -value))
    return at[order], value[order]


def search_index(index: DataFrame, asked: dict[int | None, list[int]], k: int = TOP) -> DataFrame:
    """``item_id, doc_id, score``: the best ``k`` of each block for each query, given as places
    in the vocabulary."""

    def search(rows: pa.Table) -> pa.Table:
        own, ids, known = {}, None, None
        for term, at, planes in zip(rows["term"].to_pylist(), rows["words"], rows["planes"]):
            at, planes = at.as_buffer(), planes.as_buffer()
            if term is None:
                ids, known = np.frombuffer(planes, np.int64), np.frombuffer(at, np.uint8)
            else:
                at = np.frombuffer(at, np.uint32)
                own[term] = at, np.frombuffer(planes, np.uint64).reshape(-1, len(at))
        n_words, out = (len(ids) + 63) // 64, []
        for item, terms in asked.items():
            slices = [own[t] for t in terms if t in own]
            if slices:
                at, value = top_slices(add_slices(slices, n_words), k)
                out += [(item, int(ids[a]) if known[a] else None, int(v)) for a, v in zip(at, value)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, names=["item_id", "doc_id", "score"])

    return index.groupBy("block").applyInArrow(search, "item_id long, doc_id long, score long")


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, block_rows: int = BLOCK_ROWS, part_pairs: int = PART_PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each query's best ``k`` documents with a score above
    zero, the highest first, equal scores by ascending id."""
    pairs = materialize(query_terms(queries), "query-terms")
    parts = -(-pairs.count() // part_pairs)
    out = None
    for part in range(parts):
        asked: dict[int | None, list[int]] = {}
        vocabulary: dict[str, int] = {}
        here = F.pmod(F.xxhash64(F.coalesce(F.col("item").cast("string"), F.lit(""))), F.lit(parts)) == part
        for item, term in pairs.where(here).toLocalIterator():
            asked.setdefault(item, []).append(vocabulary.setdefault(term, len(vocabulary)))
        if not asked:
            continue
        listed = materialize(postings(docs, list(vocabulary)), "postings")
        n_docs, n_terms = listed.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weights = term_weights(listed, n_docs, len(vocabulary))
        index = materialize(build_index(listed, weights, n_docs, n_terms, block_rows), "impact-index")
        found = search_index(index, asked, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS row_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
lengths AS (SELECT row_no, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY row_no),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
tf AS (SELECT row_no, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM item) GROUP BY ALL),
w AS (SELECT term, floor(1000.0 * ln((2.0 * docs + 2) / (2.0 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
impact AS (
  SELECT row_no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n::BIGINT * docs) // total))) AS impact
  FROM tf JOIN lengths USING (row_no) JOIN w USING (term), corpus
),
found AS (SELECT item_id, row_no, doc_id, sum(impact)::BIGINT AS score FROM item JOIN impact USING (term) GROUP BY ALL HAVING sum(impact) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM found)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
