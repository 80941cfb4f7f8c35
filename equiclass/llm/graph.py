"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MAX_ROUNDS = 60


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Links the neighbours of every node (u, v) to the least of them and itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    if larger_only:
        return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that it reaches) of every node with an edge to another.

    Large and small stars in turn; every round is written to the shared folder. Rounds grow
    with the logarithm of the longest path; the loop ends when all edges are stars.
    Edges of nulls and of a node to itself are left out.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    now = saved(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                .select(big.alias("u"), small.alias("v")).distinct(), "components")
    for _ in range(MAX_ROUNDS):
        # Done when all edges are stars: each node has one edge at most, to a node that has none.
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(
            now.select(F.col("v").alias("x"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        ends = ends.groupBy("x").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        most, chained = ends.agg(F.max("above"), F.max((F.col("above") > 0) & (F.col("below") > 0))).first()
        if most is None or (most <= 1 and not chained):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = saved(_star(_star(both, True).filter("u != v"), False).filter("u != v").distinct(), "components")
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots)
