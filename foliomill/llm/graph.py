"""Connected components by alternating star contractions; every step is a join or an aggregate, none is on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliomill.session import staged


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of each node's component, for edges a, b of one comparable type.

    Each round sends the larger neighbours of a node to the smallest one it knows (large star), then the smaller ones
    (small star); the number of rounds grows with the logarithm of the longest path.  Rounds are written to the shared
    folder, so a lost executor costs no earlier round.  Edges to itself and null ends are ignored.
    """
    now = staged(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:  # each round brings nodes closer to their root, so this ends
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a root may have a third of all nodes: its minimum is taken by partial aggregates, and the join back can be split
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = smallest.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = staged(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
