"""Connected components of an edge list, by alternating star contractions on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node linked to a smaller one; the component is the smallest node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, onto the smallest node known to it
    (aggregation first, so a node with many neighbours is one group of a partial minimum).  Rounds grow with the
    logarithm of the longest chain.  Edges shrink to stars; every round is a written table, so nothing is recomputed
    and a lost executor costs one task's work.
    """
    now = materialise(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = materialise(small.filter(F.col("u") != F.col("v")).distinct(), "small-star")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)).alias("h")).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = mark
