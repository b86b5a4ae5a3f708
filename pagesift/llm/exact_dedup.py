"""Exact deduplication by deterministic block naming (DataFrame operations only).

The UTF-8 bytes of a document's normalised text are cut into fixed-size blocks. The
distinct blocks of the corpus are sorted and numbered; then adjacent pairs of numbers
are sorted and numbered again, level by level, until one number is left for each
document (Karp, Miller and Rosenberg's naming). Two documents get the same final name
if and only if their texts are equal: names come from comparing contents, never
from trusting a hash.

Blocks are sorted by a 64-bit hash, then by content. A hash that one block of the
corpus has needs no content: only blocks whose hash occurs again are read a second time
and compared (least and greatest content of each hash). Which ones these are is asked before anything is shuffled, however
many there are, so contents travel for copies alone, and a group of copies is one row a task before it does. A hash with
several contents (practically none) is numbered by content.

Defined cases: null text counts as empty; equal rows that repeat a ``doc_id``
count as copies, of which one is kept; a null ``doc_id`` never is the row that
stays unless its group has no other; a text of any length is many blocks, none larger
than ``block_bytes``; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import blanks_to_space, let, materialize, release

BLOCK_BYTES = 8192
#: Repeated hashes up to which they are broadcast; rows and 64-bit words a row of the bitmap beyond.
BROADCAST_HASHES, _ROWS, _WORDS = 200_000, 4096, 1024


def _normal(text_col: str) -> Column:
    return blanks_to_space(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")


def _cut(text: Column, block_bytes: int, each: Callable[[Column], Column]) -> Column:
    """``each`` of the blocks of a binary ``text``; an empty text is one empty block."""
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1)), F.lit(block_bytes))
    return F.transform(starts, lambda at: each(F.substring(text, at, F.lit(block_bytes))))


def _documents(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, sha, hs``: the text's SHA-256 and the hashes of its blocks."""
    own = let(_normal(text_col), lambda t: F.struct(F.unhex(F.sha2(t, 256)).alias("sha"), _cut(t, block_bytes, hashed).alias("hs")))
    return docs.select(F.col(id_col).alias("doc_id"), own.alias("own")).select("doc_id", "own.*")


def _contents(docs: DataFrame, text_col: str, block_bytes: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """``h, block`` of every block."""
    rows = let(_normal(text_col), lambda t: _cut(t, block_bytes, lambda b: let(b, lambda c: F.struct(hashed(c).alias("h"), c.alias("block")))))
    return docs.select(F.explode(rows).alias("b")).select("b.*")


def _of_hashes(contents: DataFrame, again: DataFrame, bound: int) -> DataFrame:
    """The contents whose hash is in the written table ``again``. Too many hashes to broadcast are first
    set as bits of a bitmap of fixed size (32 MB), which is; so what reaches the shuffle
    of the join is the contents of repeated hashes and those that share a bit with one."""
    if again.count() <= bound:
        return contents.join(F.broadcast(again), "h", "left_semi")
    row = F.shiftright("h", 16).bitwiseAND(_ROWS - 1)
    word = F.shiftright("h", 6).bitwiseAND(_WORDS - 1).cast("int")
    bit = F.col("h").bitwiseAND(63).cast("int")
    words = again.select(row.alias("row"), word.alias("word"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit")).groupBy("row", "word").agg(F.bit_or("bit").alias("bits"))
    full = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda w: F.coalesce(F.try_element_at(F.col("set"), w), F.lit(0).cast("long")))
    bitmap = materialize(words.groupBy("row").agg(full.alias("set")).select("row", dense.alias("bits")), "hash-bitmap")
    maybe = contents.withColumn("row", row).join(F.broadcast(bitmap), "row").where(F.getbit(F.get("bits", word), bit) == 1)
    # hashes are distinct; a semi join would be moved below the bitmap's
    return maybe.select("h", "block").join(again, "h")


def _named(keys: DataFrame, *by: str) -> DataFrame:
    """Number the rows of a table of distinct keys in sort order."""
    return keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = F.xxhash64, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``doc_id, sha (binary SHA-256), level, name, m``: one row for each distinct
    pair of id and normalised text, ``m`` counting the rows that have it.
    ``(level, name)`` is the document's identity."""
    at = ["doc_id", "sha", "n", "i"]
    whole = materialize(_documents(docs, id_col, text_col, block_bytes, hashed), "block-hashes")
    rows = whole.select("doc_id", "sha", F.size("hs").cast("long").alias("n"), F.posexplode("hs").alias("i", "h")).withColumn("i", F.col("i").cast("long"))
    per_hash = materialize(rows.groupBy("h").agg(F.count("*").alias("blocks")), "hashes")
    again = per_hash.where("blocks > 1").select("h")
    contents = _of_hashes(_contents(docs, text_col, block_bytes, hashed), again, broadcast_hashes)
    compared = materialize(contents.groupBy("h").agg(F.min("block").alias("least"), F.max("block").alias("most")), "compared")
    several = compared.where("least <> most").select("h")
    keys = per_hash.select("h", F.lit(None).cast("binary").alias("block"))
    clash = bool(several.take(1))
    if clash:
        keys = keys.join(several, "h", "left_anti").unionByName(contents.join(several, "h", "left_semi").distinct())
    names = materialize(_named(keys, "h", "block"), "block-names")
    named = rows.join(names.where("block is null").select("h", "name"), "h").select(*at, "name")
    if clash:
        # a document's own blocks again, told apart by content
        placed = let(_normal(text_col), lambda t: F.struct(F.unhex(F.sha2(t, 256)).alias("sha"), _cut(t, block_bytes, lambda b: b).alias("bs")))
        placed = docs.select(F.col(id_col).alias("doc_id"), placed.alias("own")).select("doc_id", "own.sha", F.size("own.bs").cast("long").alias("n"), F.posexplode("own.bs").alias("i", "block"))
        placed = placed.withColumn("i", F.col("i").cast("long")).withColumn("h", hashed(F.col("block")))
        named = named.unionByName(placed.join(names.where("block is not null"), ["h", "block"]).select(*at, "name"))
    rows = materialize(named.withColumn("m", F.lit(1).cast("long")), "blocks")
    release(whole, per_hash, compared, names)

    deepest = rows.agg(F.max("n")).first()[0] or 1
    done = [rows.where("n = 1").groupBy("doc_id", "sha", "name").agg(F.sum("m").alias("m")).withColumn("level", F.lit(0))]
    level = 0
    while deepest > 1:
        level, deepest = level + 1, (deepest + 1) // 2
        even = F.col("i") % 2 == 0
        pairs = rows.where("n > 1").groupBy("doc_id", "sha", F.expr("(n + 1) div 2").alias("n"), F.expr("i div 2").alias("i")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.sum(F.when(even, F.col("m"))).alias("m"),
        )
        names = _named(pairs.select("a", "b").distinct(), "a", "b")
        rows = materialize(pairs.join(names, ["a", "b"]).select(*at, "name", "m"), "pairs")
        done.append(rows.where("n = 1").select("doc_id", "sha", "name", "m").withColumn("level", F.lit(level)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``. Of equal texts the row with the smallest id is kept."""
    ids = identities(docs, id_col, text_col, **how)
    # written, so that the join below reads plain exchanges on both sides and a hot
    # group can be split over tasks
    groups = materialize(ids.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("m").alias("group_size")), "text-groups")
    rows = ids.join(groups, ["level", "name"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
