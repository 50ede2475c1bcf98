"""Connected components by star contraction, in rounds of joins.

Each round hangs every neighbour of a node that is larger than it on the smallest node that
either knows (large star), then does so for the smaller ones (small star).  Rounds end when the edges
stay as they are: each component is then a star around its smallest node.  The number of
rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlog.llm.common import written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = seen.join(least, "u")
    if large:
        hung = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of each node that a pair (a, b) of longs names; component is its smallest node."""
    edges = written(pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        edges = written(star(star(edges, True), False), "edges")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
