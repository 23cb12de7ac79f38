"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch, stored


#: Edges that a task writes at least: rounds of few edges leave few files.
EDGES_PER_FILE = 500_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't its component's least.

    Each round writes its edges, never more than the round before, to the shared folder. A node of any degree is only ever
    a join key, which adaptive execution splits, or summed by partial aggregates.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select("a", "b").distinct()
    seen, path, rows = None, None, now.count()
    for _ in range(most):
        new = scratch(spark, "stars")
        now = stored(_small(_large(now)).coalesce(1 + rows // EDGES_PER_FILE), "stars", new)
        if path:
            drop_scratch(spark, path)
        path = new
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, rows = sign, sign[0]
    raise RuntimeError(f"no fixed point after {most} rounds")
