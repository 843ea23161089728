"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b).

    Each round hangs neighbours under the smallest one they know; a round is written to the shared folder, so lineage stays
    short. A node with many edges is combined before the shuffle, and its join is one Spark can split. It ends when every node
    hangs under one other that hangs under none.
    """
    now = stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u != v").distinct(), "stars")
    while True:
        up = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(False).alias("over"))
        ends = up.unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(True).alias("over")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("over").alias("over")).where("up > 1 or (up = 1 and over)").isEmpty():
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.unionByName(least.where("m != u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
