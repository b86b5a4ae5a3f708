"""The corpus operators as queries over the input tables, and their SQL.

A query applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import ann, bpe_tree, exact_dedup, html_wrapper, impact_index, importance, langid, line_dedup, mixing, pii, simhash, token_count, warc
from pagesift.llm.common import table


def _vocabulary(name: str) -> tuple[str, str]:
    """Path and splitting pattern of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_digest(table(spark, sf_dir, "pages"), min_payload=0)
    # where a record lies depends on how Spark splits its input; the operator returns it
    return rows.drop("bundle", "frame", "offset")


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_text(table(spark, sf_dir, "pages"))


def op3_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), *_vocabulary("byte_bpe_50k.json"))


def op5_balanced_lists_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_bitsliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(table(spark, sf_dir, "documents"))


#: Target weights of the mixing query: domains, then languages, then sources alike.
BOOKS = [f"src{i}" for i in range(1, 7)]


def mix_documents(docs: DataFrame, budget: float, max_epochs: int, carry: bool = False) -> DataFrame:
    """The production tree of :func:`op8_hierarchical_mix` over ``docs``."""
    domain = F.when(F.col("source") == "src0", "crawl").when(F.col("source").isin(BOOKS), "books").otherwise("web")
    levels = {"mix_domain": domain, "mix_lang": F.col("lang"), "mix_source": F.col("source")}
    weights = {
        "mix_domain": F.when(F.col("mix_domain") == "books", 4).otherwise(3),
        "mix_lang": F.when(F.col("mix_lang") == "en", 6).when(F.col("mix_lang") == "de", 3).otherwise(2),
        "mix_source": F.lit(1),
    }
    return mixing.mix(docs, levels, weights, budget, max_epochs, seed=17, carry=carry)


def op8_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), budget=0.75, max_epochs=2)


_MIX_LEVEL = """
{name}_c AS (SELECT {path}, sum(tokens) * 2 AS cap, {w} AS w FROM leaf GROUP BY {path}),
{name}_p AS (SELECT c.*, p.budget AS b, (cap::HUGEINT * 1000000) // w AS ratio FROM {name}_c c JOIN {parent} p {on}),
{name}_o AS (SELECT *, sum(cap) OVER u - cap AS before, sum(w) OVER ({part}) - sum(w) OVER u + w AS rest FROM {name}_p
  WINDOW u AS ({part} ORDER BY ratio, {last} ROWS UNBOUNDED PRECEDING)),
{name}_f AS (SELECT *, cap::HUGEINT * rest <= w::HUGEINT * (b - before) AS is_full FROM {name}_o),
{name}_s AS (SELECT *, b - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0) AS lft, sum(w) FILTER (NOT is_full) OVER ({part}) AS opn FROM {name}_f),
{name} AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE (w::HUGEINT * lft) // opn END AS budget FROM {name}_s)"""

_MIX_ORACLE = (
    r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN source IN ('src1','src2','src3','src4','src5','src6') THEN 'books' ELSE 'web' END AS mix_domain,
         coalesce(lang, '(none)') AS mix_lang, coalesce(source, '(none)') AS mix_source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents
),
leaf AS (SELECT mix_domain, mix_lang, mix_source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
total AS (SELECT floor(sum(n_tokens)::DOUBLE * 0.75)::HUGEINT AS budget FROM d),"""
    + ",".join(
        [
            _MIX_LEVEL.format(name="l1", path="mix_domain", w="CASE WHEN mix_domain = 'books' THEN 4 ELSE 3 END", parent="total", on="ON true", part="PARTITION BY 1", last="mix_domain"),
            _MIX_LEVEL.format(name="l2", path="mix_domain, mix_lang", w="CASE mix_lang WHEN 'en' THEN 6 WHEN 'de' THEN 3 ELSE 2 END", parent="l1", on="USING (mix_domain)", part="PARTITION BY mix_domain", last="mix_lang"),
            _MIX_LEVEL.format(name="l3", path="mix_domain, mix_lang, mix_source", w="1", parent="l2", on="USING (mix_domain, mix_lang)", part="PARTITION BY mix_domain, mix_lang", last="mix_source"),
        ]
    )
    + r""",
plan AS (SELECT mix_domain, mix_lang, mix_source, coalesce(budget // nullif(tokens, 0), 0)::BIGINT AS epochs, coalesce(budget % nullif(tokens, 0), 0)::BIGINT AS rest
         FROM leaf JOIN l3 USING (mix_domain, mix_lang, mix_source)),
ordered AS (
  SELECT d.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY md5('17:' || epochs || ':' || coalesce(doc_id::VARCHAR, '#' || n_tokens)), n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN plan USING (mix_domain, mix_lang, mix_source)
)
SELECT doc_id, mix_domain, mix_lang, mix_source, n_tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM ordered
"""
)


def op9_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_digests(table(spark, sf_dir, "documents"), *_vocabulary("byte_bpe_50k.tiktoken"))


def op11_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_warc_bundles, op2_html_wrapper, op3_string_kernel_langid, op4_heap_token_counts, op5_balanced_lists_ann, op6_bitsliced_simhash, op7_fuzzy_lines, op8_hierarchical_mix, op9_block_naming_dedup, op10_tree_bpe, op11_disclosure_pii, op12_importance_resampling, op13_bitsliced_search, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_bundles": warc.ORACLE, "op8_hierarchical_mix": _MIX_ORACLE, "op9_block_naming_dedup": exact_dedup.ORACLE, "op11_disclosure_pii": pii.ORACLE, "op13_bitsliced_search": impact_index.ORACLE}
