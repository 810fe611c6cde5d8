"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); a component is named by its smallest node.

    Alternating large and small stars: each round links every node's larger (then smaller)
    neighbours to the smallest one, which keeps components and halves long paths. Minima
    come from combining aggregates, are written to the shared folder, and meet the edges in
    joins of two plain shuffles, whose large partitions Spark splits, so a node with very many
    edges is no single task. Self-loops and repeated edges are allowed.
    """
    star = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = stage(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = stage(small)
        # Done when each larger node has one edge and no smallest node is anyone's larger one.
        roots = new.select(F.col("b").alias("a")).distinct()
        if new.join(roots, "a", "left_semi").isEmpty() and new.groupBy("a").count().filter("count > 1").isEmpty():
            break
        star = new
    nodes = new.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
