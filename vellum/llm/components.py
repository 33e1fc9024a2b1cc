"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._store import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of it and its neighbours."""
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them; every edge of `e` has a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of `edges` (two bigint columns) but the roots; root is the least node of its component.

    A few rounds in the logarithm of the nodes; each is written to the shared folder, which cuts the
    lineage, and only its count and a hash come to the driver. A node with very many neighbours is a
    partial minimum in every task and a skewed join that Spark splits. Null ends and loops are dropped.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    e = e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    before = None
    while True:
        e = stored(_small_star(_large_star(e)), "components")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
