"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import release, staged


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or only edges up: each component is a star round its least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return node.where("down > 1 or (down = 1 and up = 1)").limit(1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v); root is the least node that can be reached.

    A step joins each node's edges with the least of its neighbours; that
    least is summed before the shuffle and staged, so a node with very many
    edges may be split by adaptive execution. Ends when all components are stars.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.unionByName(now.join(least, "u").where("m = v").select("u", "v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # a node has few neighbours below itself by now
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(least, large, old)
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
