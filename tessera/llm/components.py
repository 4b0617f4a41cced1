"""Connected components of an edge table, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the long columns a, b: component is the smallest node reachable; nodes without edges are absent.

    Each round every node follows its neighbour of lowest rank, if lower than its own, and edges
    are carried over to what their ends follow. In the first round the node is its rank (stars
    around their smallest node end there), later ranks are random and new in each round, so a
    constant share of the nodes goes, chains included. Each round ends in the shared folder.
    A hot node is one row after partial aggregation; joins on it are split by Spark.
    """
    edges = C.stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, first = None, edges
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)) if turn > 1 else F.lit(0), F.col(c))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min(rank("b")).alias("low"))
        follows = C.stash(lowest.select(F.col("a").alias("node"), F.when(F.col("low") < rank("a"), F.col("low")["b"]).otherwise(F.col("a")).alias("to")))
        ends = [follows.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b")
        left = C.stash(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if labels is None:
            now = follows
        else:
            now = C.stash(labels.join(follows.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        for x in (labels, edges if edges is not first else None):
            if x is not None:
                C.drop_stash(x)
        labels, edges = now, left
    if labels is None:
        return first.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    least = labels.groupBy("to").agg(F.min("node").alias("component"))
    return labels.join(least, "to").select("node", "component")
