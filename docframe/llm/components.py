"""Connected components by alternating large-star and small-star steps, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

MAX_ROUNDS = 60


def settled(edges: DataFrame) -> bool:
    """Whether the distinct ``edges(a, b)`` form stars: no a has two edges or is a b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()


def components(edges: DataFrame, tables: Written) -> DataFrame:
    """(node, component): the least node that each node of ``edges(a, b)`` reaches.

    Every round is grouped minima and inner joins on the node; the number of
    rounds grows with the logarithm of the longest chain.  Rounds end when each
    node is a root or has one edge, to a root; edges that are so from the start
    take none.  Nothing is collected but whether a node breaks this.
    """
    now = tables.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if settled(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        head = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(head, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(head.select("a", F.col("m").alias("b"))).distinct()
        after = tables.put(small, "edges")
        tables.drop(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)
