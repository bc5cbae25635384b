"""Connected components of an edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spreadlake.session import materialize


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node on an edge (a, b); the root is the smallest node
    reachable. Each round links neighbours to the smallest one, first the larger and
    then the smaller neighbours, and ends when every edge points at its root; long
    chains shrink by half or more in each round. Rounds are written to the shared
    folder, so a lost executor costs the round it was in."""
    both = edges.filter("a <> b").select("a", "b")
    edges = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    for _ in range(max_rounds):
        # larger neighbours move to the smallest of the neighbourhood
        low = _smallest_neighbour(edges).select("a", F.least("a", "low").alias("low"))
        large = edges.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # then every node and its smaller neighbours point at the smallest of them
        large = large.filter("a <> b").distinct()
        low = _smallest_neighbour(large)
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                                      F.struct("a", F.col("low").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a <> b").distinct()
        )
        down = materialize(small)
        # done when no node is both below another and above one
        middle = down.select("a").distinct().join(down.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        twice = down.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if middle.isEmpty() and twice.isEmpty():
            roots = down.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
