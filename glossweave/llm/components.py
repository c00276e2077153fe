"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b: long).

    A large-star step hangs each node's larger neighbours on its least neighbour; a small-star step
    hangs its smaller neighbours there. A node's minimum is pre-aggregated before the shuffle and joined
    back to the edges by a sort-merge join that Spark can split, so a node with very many edges does not
    meet in one task. The number of rounds grows with the logarithm of the longest path. Each round is
    written to the shared folder, so lost executors cost one round at most. Nulls and loops are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = materialize(pairs, "components-0")
    for step in range(max_rounds):
        if stars.isEmpty():
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"components-{step}-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, f"components-{step}-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"components-{step}-low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        after = materialize(small.where("u <> v").distinct(), f"components-{step + 1}", release=True)
        discard(stars, least, large, low)
        ends = after.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(after.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        degree = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        done = degree.where("child > 1 or (child > 0 and parent > 0)").isEmpty()  # only stars are left
        stars = after
        if done:
            break
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
