"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partial minimum and a join on the vertex; nothing is gathered
by group, so a star with many leaves is as cheap as many small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import written

MOST_ROUNDS = 60


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("m", "a").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the smallest vertex of its component."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not now.limit(1).count():
        return now.select(F.col("a").alias("v"), F.col("b").alias("c"))
    mark = None
    for _ in range(MOST_ROUNDS):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a vertex go to the least of its neighbours and itself.  The least is written, so
        # that its join has plain shuffles on both sides: Spark can then split the edges of one vertex over tasks.
        large = both.join(written(_least(both)), F.col("a") == F.col("_a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the vertex and its neighbours below go to the least of them.
        least = _least(large)
        small = large.join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = written(small.union(least.select("_a", "m")).distinct())
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            return now.select(F.col("a").alias("v"), F.col("b").alias("c")).union(now.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
        mark = new
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
