"""Exact dedup reads contents of repeated blocks only, however many hashes repeat."""

from collections import Counter

from pyspark.sql import functions as F

from pagesift.llm import exact_dedup


def test_contents_are_filtered_before_they_are_shuffled(spark):
    rows = [(i, ("copy %d " % (i % 40)) * 9 if i < 400 else f"own text {i} " * 7) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(map(tuple, exact_dedup.exact_dedup(docs, block_bytes=16).collect()))
    got = Counter(map(tuple, exact_dedup.exact_dedup(docs, block_bytes=16, broadcast_hashes=5).collect()))
    assert got == want and len(want) == 900
    # two kinds of collision at once: many contents share each hash, and each bit
    weak = lambda b: F.xxhash64(b) % 50
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, block_bytes=16, hashed=weak, broadcast_hashes=5).collect())) == want


def test_the_large_side_meets_the_bitmap_first(spark):
    contents = spark.range(20_000).select(F.xxhash64("id").alias("h"), F.encode(F.repeat(F.lit("x"), 50), "UTF-8").alias("block"))
    again = spark.range(300).select(F.xxhash64(F.col("id") * 7).alias("h")).cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = exact_dedup._of_hashes(contents, again, bound=10)
        assert kept.count() == 300
        plan = kept._jdf.queryExecution().executedPlan().toString()
        below = plan.split("Exchange hashpartitioning(h", 1)[1].split("Exchange hashpartitioning(h", 1)[0]
        assert "BroadcastHashJoin" in below and "Range (0, 20000" in below, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        again.unpersist()
