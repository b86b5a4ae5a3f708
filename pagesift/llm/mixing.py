"""Mixing sources to target weights by hierarchical budgeting (DataFrame
operations only).

A tree (for instance domain, language, source) has a weight at every node and a
token supply at every leaf: its tokens times ``max_epochs``. The budget goes down
the tree. Among siblings it is dealt by weight; a child whose whole subtree can't
use its share gets what it can use, and the shortage goes to its siblings, so an
ancestor's siblings get some only if the whole family is exhausted. All sums are
integers (tokens; shares rounded down), so any engine gives the same numbers.

A leaf's budget is then so many whole epochs and one token-prefix of the next:
documents in the order of a hash of seed, epoch and id, while their running sum
is within what is left. The prefix is found without sorting a leaf in one task:
a leaf of n rows is cut into about sqrt(n) hash ranges, tokens are summed by range, and
only the range in which the budget ends is ordered row by row, so no task orders more than
about sqrt(n) ranges or rows of a leaf.

Defined cases: null branch values are the branch ``(none)``; null text has no
tokens; a weight of zero or less gets nothing; documents without tokens are taken
if they precede the end of a prefix; rows that repeat an id are ordered by their
token count and are interchangeable, and so are rows without an id that have equal counts
(their place comes from the count, so that many of them spread over the ranges); a text of
any length is counted whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import BLANKS, join_checked, materialize

NONE = "(none)"
_D = "decimal(20,0)"


def count_words(text: Column) -> Column:
    """Tokens of a text for budgeting: its words between ASCII blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: int, max_epochs: int) -> DataFrame:
    """Leaf budgets: ``levels, tokens, rows, budget``. ``leaves`` has one row a leaf
    with ``tokens`` and ``rows``; ``weights[level]`` is an integer column over the
    branch names down to that level."""
    given = leaves.select(F.lit(budget).cast("long").alias("budget")).limit(1)
    for depth, level in enumerate(levels):
        path, parent = levels[: depth + 1], levels[:depth]
        node = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("long").alias("cap")).withColumn("w", weights[level].cast("long")).where("w > 0")
        node = (node.join(given, parent) if parent else node.crossJoin(given)).withColumn("ratio", F.expr(f"cast(cap as {_D}) * 1000000 div w"))
        family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        upto = family.orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        node = node.withColumn("before", F.sum("cap").over(upto) - F.col("cap")).withColumn("rest", F.sum("w").over(family) - F.sum("w").over(upto) + F.col("w"))
        full = F.expr(f"cast(cap as {_D}) * cast(rest as decimal(12,0)) <= cast(w as decimal(12,0)) * cast(budget - before as {_D})")
        node = node.withColumn("full", full)
        node = node.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)))
        node = node.withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(family))
        share = F.expr(f"cast(cast(w as decimal(12,0)) * cast(left as {_D}) div open as long)")
        given = node.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(share).alias("budget"))
    return leaves.join(given, levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], budget: int | float, max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", tokens: Column | None = None, range_rows: int | None = None, carry: bool = False) -> DataFrame:
    """``doc_id, <levels>, n_tokens, copies`` for every row; ``copies`` is how often the
    document is taken. ``budget`` counts tokens, or is a share of all if under 1. With
    ``carry`` a row's own columns come along as the struct ``row``."""
    names = list(levels)
    tokens = count_words(F.col("text")) if tokens is None else tokens
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()], tokens.alias("n_tokens"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    rows = materialize(rows, "mix-rows")
    leaves = materialize(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-leaves")
    if 0 < budget < 1:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget)
    plan = budgets(leaves, names, weights, int(budget), max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div greatest(tokens, 1)")).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % greatest(tokens, 1)")).otherwise(F.lit(0)).cast("long"))
    ranges = F.ceil(F.sqrt("rows")) if range_rows is None else F.ceil(F.col("rows") / range_rows)
    plan = plan.withColumn("ranges", ranges.cast("long"))
    plan = materialize(plan.select(*names, "epochs", "rest", "ranges"), "mix-plan")

    placed = join_checked(rows, plan, names)
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("n_tokens").cast("string")))))
    placed = placed.withColumn("mark", mark)
    at = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("range", F.shiftright(at * F.col("ranges"), 32))
    sums = placed.where("rest > 0").groupBy(*names, "range", "rest").agg(F.sum("n_tokens").alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sums.withColumn("upto", run).where("upto > rest")
    ends = ends.groupBy(*names).agg(F.min(F.struct("range", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
    ends = materialize(ends.select(*names, F.col("end.range").alias("end_range"), F.col("end.before").alias("end_before")), "mix-ends")
    placed = join_checked(placed, ends, names, "left")
    inside = (F.col("rest") > 0) & (F.col("range") == F.col("end_range"))
    # the rows of the other ranges need no order
    running = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("mark", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ["doc_id", *names, "n_tokens", *(["row"] if carry else [])]
    last = placed.where(inside).withColumn("run", running + F.col("end_before"))
    last = last.select(*out, (F.col("epochs") + (F.col("run") <= F.col("rest")).cast("long")).alias("copies"))
    before = (F.col("rest") > 0) & (F.col("range") < F.coalesce("end_range", F.lit(1 << 40)))
    other = placed.where(~F.coalesce(inside, F.lit(False))).select(*out, (F.col("epochs") + before.cast("long")).alias("copies"))
    return other.unionByName(last)
