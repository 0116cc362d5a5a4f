"""Connected components of an edge table, by alternating large and small stars.

Every round attaches each node's neighbours to the smallest node it knows.  Rounds are
written to the shared folder, so a lost executor costs at most one round.  Only a count and
a checksum of the edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.session import checkpoint


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node reached.

    Nodes are of any ordered type.  Self-loops, repeated and null edges have no effect.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpoint(edges.where("a != b").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(small.union(least).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(edges.select("b", "b").distinct().join(roots, F.col("b") == F.col("node"), "left_anti"))
