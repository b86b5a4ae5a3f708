"""Importance resampling towards a target distribution.

Texts become bags of hashed word n-grams: every run of 1 to ``n_grams`` words falls into
one of ``buckets`` by CRC-32. A bucket's gain is the log ratio of its smoothed share in
the target to that in the corpus, in whole thousandths; a document's weight is the mean
gain of its features, looked up in one array of gains. A Gumbel variable made from seed and
id is added, so that the highest scores are a draw without replacement.

The draw is exact and sorts no more than it takes. The place of the k-th row in the
order (score down, id up) is found by radix selection: one aggregation for each digit of the
composite key counts the rows by that digit under the digits known so far. The digits
start where scores or ids first differ, and the search ends as soon as a digit's rows are
taken whole. Only the selected rows are sorted by range, and ranked from their place
in a partition and the counts of the partitions before.

What reaches the driver has a fixed bound: the gains (``buckets`` numbers) and the counts of
one digit (at most 4,096 a pass).

Defined cases: null text has no words, weight 0; texts of any length are counted whole; a
null id hashes like an empty one and comes last among equal scores; rows that repeat an id
and a score are ordered by features and weight, and are interchangeable if these agree too;
an empty corpus gives no rows, with an empty target every gain stems from the smoothing; other
columns are not read. Ids are whole numbers (any type that casts to ``long``).
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import join_checked, materialize
from pagesift.llm.pieces import PieceCache
from pagesift.llm.words import words

BUCKETS, N_GRAMS, SEED, MIN_WORDS = 10_000, 2, 7, 20
#: Bits of a digit: a pass brings at most 2 ** DIGIT counts to the driver.
DIGIT = 12
_LAST_ID = (1 << 63) - 1
_ROWS = (1 << 33) - 1


def features(tokens: list[bytes], n_grams: int, crcs: PieceCache) -> list[int]:
    """CRC-32 of every run of 1 to ``n_grams`` words joined by a blank. A longer run's
    continues that of the run without its last word."""
    run = list(map(crcs.__getitem__, tokens))
    out = run
    for n in range(1, n_grams):
        run = list(map(zlib.crc32, tokens[n:], map(zlib.crc32, itertools.repeat(b" "), run)))
        out = out + run
    return out


def bucket_counts(texts: DataFrame, n_grams: int, buckets: int) -> DataFrame:
    """``bucket, n``: how many features of a table's ``text`` fall into each bucket."""

    def count(batches):
        crcs, counts = PieceCache(zlib.crc32), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = features(words(text.as_py()), n_grams, crcs)
                if found:
                    counts += np.bincount(np.array(found, np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_grams: int = N_GRAMS, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket; the two tables need a column ``text`` each."""
    own = bucket_counts(docs, n_grams, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, n_grams, buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").alias("bucket"))
    both = every.join(own, "bucket", "left").join(wanted, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    whole = Window.partitionBy(F.lit(0))  # of ``buckets`` rows
    up = (F.col("t") + 1).cast("double") * (F.sum("s").over(whole) + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.sum("t").over(whole) + buckets).cast("double")
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain")).collect()
    return [gain for _, gain in sorted(rows)]


def scores(docs: DataFrame, gain: list[int], n_grams: int = N_GRAMS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    table = np.array(gain, np.int64)

    def weigh(batches):
        crcs = PieceCache(zlib.crc32)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(1):
                tokens = words(text.as_py())
                found = features(tokens, n_grams, crcs)
                n_words.append(len(tokens))
                n_features.append(len(found))
                weight.append(int(table[np.array(found, np.int64) % len(table)].sum()) // len(found) if found else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + gumbel)


def _digits(key: Column, bits: int) -> list[Column]:
    """The lowest ``bits`` of a column, cut into digits from the top."""
    return [F.shiftrightunsigned(key, at).bitwiseAND((1 << min(DIGIT, bits - at)) - 1) for at in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT)] if bits else []


def first_k(rows: DataFrame, k: int) -> Column:
    """A condition on ``score`` and ``place`` that holds for the first ``k`` of ``rows`` in the
    order (score down, place up), and for further ones only if they equal the k-th in both.
    ``rows`` should be cheap to read again: a pass is made for each digit."""
    if k <= 0:
        return F.lit(False)
    low, high, least, most = rows.agg(F.min("score"), F.max("score"), F.min("place"), F.max("place")).first()
    digits = _digits(F.lit(high) - F.col("score"), (high - low).bit_length()) + _digits(F.col("place"), ((least ^ most) & ((1 << 64) - 1)).bit_length())
    if least < 0 <= most:  # the sign is the highest bit that differs, and counts the other way
        digits = _digits(F.lit(high) - F.col("score"), (high - low).bit_length()) + _digits(F.col("place").bitwiseXOR(-(1 << 63)), 64)
    known: list[tuple[Column, int]] = []
    left, within = k, rows
    for digit in digits:
        counts = sorted(within.groupBy(digit.alias("d")).count().collect())
        for value, n in counts:
            if n >= left:
                break
            left -= n
        known.append((digit, value))
        if n == left:  # all rows with this digit are taken
            break
        within = within.where(digit == value)
    taken = F.lit(True)
    for digit, value in reversed(known):
        taken = (digit < value) | ((digit == value) & taken)
    return taken


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = MIN_WORDS, n_grams: int = N_GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` counts the
    ``percent`` of the documents with ``min_words`` that are drawn, and is null for the others."""
    gain = gains(docs, target, n_grams, buckets)
    scored = scores(docs, gain, n_grams, seed).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored.withColumn("place", F.coalesce("doc_id", F.lit(_LAST_ID))), "importance-scores")
    able = scored.where(F.col("n_words") >= min_words)
    k = able.count() * percent // 100
    first = (F.col("n_words") >= min_words) & first_k(able, k)

    # ``row`` spreads rows that repeat an id over ranges; it decides between equal rows only
    ordered = scored.where(first).orderBy(F.desc("score"), "place", "n_features", "weight", "row")
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    sizes = materialize(sizes.select("part", before.alias("before")), "importance-parts")
    ranked = join_checked(ordered.withColumn("part", part), sizes, "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(_ROWS) + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return scored.where(~first).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(drawn)
