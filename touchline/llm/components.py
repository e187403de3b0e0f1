"""Connected components by alternating large-star and small-star.

Each step is a minimum per node (partial sums before the shuffle) that is written, and a join of plain tables, whose
hot partitions adaptive execution can split: a hub's edges never meet in one task or list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut


def least(edges: DataFrame) -> DataFrame:
    """`node, low`: the smallest of a node and its neighbours `other`."""
    return edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("low"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node about it."""
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a"))), "large")
    joined = both.filter("other > node").join(cut(least(both), "lows"), "node")
    return cut(joined.select(F.col("other").alias("a"), F.col("low").alias("b")).filter("a != b").distinct(), "edges")


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, moves to the smallest of them."""
    down = cut(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")), "small")
    lows = cut(least(down), "lows")
    joined = down.join(lows, "node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    own = lows.select(F.col("node").alias("a"), F.col("low").alias("b"))
    return cut(joined.union(own).filter("a != b").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """`node, component`: the smallest node reachable, for each node with an edge. Edges: `a, b` (long, not null)."""
    now = cut(edges.select("a", "b").filter("a != b").distinct(), "edges")
    seen = None
    while True:
        count = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not count[0] or count == seen:
            break
        seen = count
        now = small_star(large_star(now))
    # every edge now leads from a node to the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
