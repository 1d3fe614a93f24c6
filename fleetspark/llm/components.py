"""Distributed union-find: connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.tables import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is its component's smallest node.

    Each round links all larger neighbours of a node to its smallest neighbour, then all smaller
    ones, until nothing moves.  Rounds grow with the logarithm of the longest path.  Each round is
    written to the shared folder, where it stays for the next round only, so a lost executor costs one round at most.  No task holds a
    node's whole neighbourhood: smallest neighbours are pre-aggregated and joined back.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    state = None
    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark, "edges")
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(smallest, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        before, current = current, written(moved.where(F.col("a") != F.col("b")).distinct(), spark, "edges")
        discard(spark, before)
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state:
            break
        state = seen
    # Every edge now leads from a node to its root.
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
