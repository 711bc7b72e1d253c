"""Connected components of an edge table, with all data in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` -> ``node``, ``root``: every node of an edge with the least node of its component.

    An edge with a null end, or from a node to itself, joins nothing and is left out; repeated edges count once.

    Each round hooks every node to its least neighbour, follows that pointer once more and contracts the graph
    to the pointers. Nodes should be numbered without order (hashes), so that chains shrink by a factor each round.
    Rounds are cut by the checkpoint folder; only the question whether edges are left reaches the driver.
    """
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("up"))
        jump = cut(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root"))
        if labels is None:
            labels = jump
        else:
            step = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = cut(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left, right = (jump.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        edges = edges.join(left, "a").join(right, "b").where(F.col("ra") != F.col("rb"))
        edges = cut(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return labels
