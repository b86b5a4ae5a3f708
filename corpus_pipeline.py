"""A training-corpus pipeline over ``documents``: five stages, each written as
Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import bpe_tree, exact_dedup, langid, simhash
from pagesift.llm.common import blanks_to_space, fresh, materialize, release, scratch, table
from pagesift.llm.queries import _vocabulary, mix_documents

#: A document is rejected below this language score. The outputs of L regressions sum
#: to 2 - L, so the best score is at least 1 / L: this alone rejects no text with a
#: letter while there are fewer than ten languages, and strange texts go by themselves.
MIN_SCORE = 0.1
#: Share of the tokens that the mixture keeps; no document is taken twice.
MIX_BUDGET = 0.9

def _kept(docs: DataFrame, ids: DataFrame, *also: str) -> DataFrame:
    """The rows of ``docs`` whose id (and what ``also`` names) is in ``ids``; a null id is
    an id like any other."""
    key = {c: fresh(docs, f"kept_{c}") for c in ["doc_id", *also]}
    wanted = ids.select(*[F.col(c).alias(k) for c, k in key.items()])
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in key.items()]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return docs.join(wanted, on, "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, those that no language claims and those that
    are strange to the language that claims them. Null text has no letter and goes; a null id is
    passed on like any other, and rows that repeat an id are decided each by their text; without a
    labelled row, or of an empty table, nothing is kept."""
    lang, score, strange = (fresh(docs, f"lang_{n}") for n in ("pred", "score", "strange"))
    marked = langid.with_language(docs, langid.train(docs), "text", lang, score, strange)
    good = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE) & ~F.col(strange)
    return marked.where(good).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts; of rows that repeat an id and
    a text, one. Null text is empty and equal to every other such; a row without an id stays
    if its group has none with one; an empty table keeps nothing."""
    sha = fresh(docs, "text_sha256")
    decided = exact_dedup.exact_dedup(docs).withColumnRenamed("text_sha256", sha)
    hashed = docs.withColumn(sha, F.sha2(blanks_to_space(F.coalesce("text", F.lit(""))), 256))
    kept = _kept(hashed, decided.where("kept"), sha)
    repeated = decided.groupBy("doc_id", sha).agg(F.count("*").alias("rows")).where("rows > 1")
    if repeated.take(1):
        kept = kept.dropDuplicates(["doc_id", sha])
    return kept.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document that names each SimHash component. Rows that share an id,
    null included, are one document and stay or go together."""
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return _kept(docs, simhash.simhash_components(docs).where(named))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the budgets of domains, languages and sources take. Rows are
    taken one by one, also where they share an id; null text has no tokens and is
    taken if it precedes the end of its leaf's prefix."""
    taken = mix_documents(docs, MIX_BUDGET, max_epochs=1, carry=True).where("copies > 0")
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of what is left, as digests with token counts; null text is
    empty, a null or repeated id is passed on."""
    return bpe_tree.encode_digests(docs, *_vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("langid", language), ("exact", exact), ("near", near), ("mix", mixture), ("bpe", encode)]

#: The string-kernel classifier and XXH64 fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as keep:  # a stage's own tables go once its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(docs)
        release(last)
        last = docs
    return docs
