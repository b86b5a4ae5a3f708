"""Helpers shared by the corpus operators: tables, shared storage, size-checked
broadcasts and distributed connected components."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular-expression class of the six ASCII blanks every contract names.
BLANKS = r"\x20\x09-\x0D"

_written: dict[str, SparkSession] = {}


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started: its
    folder joins the workers' path. On a cluster without that folder, ship the
    package with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone so that any store works."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a session of one process (tests, a laptop) that names none gets a temporary one;
    executors of a cluster would not find it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="pagesift-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a
    lost executor costs a re-read only. Tables go when the process ends, or
    earlier through :func:`release`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._pagesift_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_pagesift_path", None)
        if path and _written.pop(path, None) is not None:
            _delete(df.sparkSession, path)


@contextmanager
def scratch():
    """Tables written inside, but for those that ``keep`` (what it yields) is called with, are
    deleted at the end: for work whose result is written itself."""
    before, kept = set(_written), set()
    yield lambda df: kept.add(getattr(df, "_pagesift_path", None))
    for path in set(_written) - before - kept:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is None:
                continue
            _delete(spark, path)
        except Exception:  # the session is gone; the folder is its owner's to sweep
            return


def join_checked(df: DataFrame, small: DataFrame, on, how: str = "inner", bound: int = 200_000) -> DataFrame:
    """Join with a broadcast of ``small`` if it is counted to have at most
    ``bound`` rows, else with a shuffle that adaptive execution can split.
    ``small`` should be cheap to count (a materialized table)."""
    rows = small.count()
    return df.join(F.broadcast(small) if rows <= bound else small, on, how)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that ``df`` has no column of, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def blanks_to_space(c: Column) -> Column:
    """Every run of ASCII blanks becomes one space. The pattern matches only runs
    that change, so ordinary prose is scanned without a replacement a word."""
    return F.regexp_replace(c, rf"[\x09-\x0D][{BLANKS}]*|\x20[{BLANKS}]+", " ")


def connected_components(edges: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star
    rounds (Kiveris et al. 2014), as joins and aggregations only.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Returns ``node``,
    ``component`` (the component's smallest node) for every node that has an
    edge to another node. Nothing but two numbers a round reaches the driver;
    every round is written to the shared folder. A hub's neighbours are aggregated before
    any join, and what is joined to them is a written table, so that a join at a hub can
    be split over tasks.
    """
    stars = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{label}-edges",
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    known = state(stars)
    for _ in range(max_rounds if known[0] else 0):
        both = stars.select(F.col("v").alias("n"), F.col("u").alias("m")).union(stars.select(F.col("u").alias("n"), F.col("v").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("m"))
        least = materialize(least.select(F.col("n").alias("v"), F.least("n", "m").alias("w")), f"{label}-least")
        large = stars.join(least, "v").select("u", F.col("w").alias("v")).where(F.col("u") != F.col("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(roots, "u").select(F.explode(F.array(F.struct("v", "w"), F.struct(F.col("u").alias("v"), "w"))).alias("e"))
        small = small.select(F.greatest("e.v", "e.w").alias("u"), F.least("e.v", "e.w").alias("v")).where(F.col("u") != F.col("v")).distinct()
        after = materialize(small, f"{label}-round")
        now = state(after)
        release(stars, least)
        stars = after
        if now == known:
            break
        known = now
    else:
        if known[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
