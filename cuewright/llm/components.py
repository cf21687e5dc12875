"""Connected components of distributed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import forget, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (long, any order, no nulls). Returns node, root for each node that has a link: root is the smallest
    node that it reaches. Alternates large-star and small-star steps (Kiveris et al., 2014): each is a groupBy, rows never
    exceed the number of links, and a star of any size takes one round. Both sides of a step are salted by nothing but
    the node; the minimum is summed before the shuffle."""
    now = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a node links to the node's smallest neighbour (or itself).
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # Small star: a node and its smaller neighbours link to the smallest of them.
        small = big.distinct()
        least = small.groupBy("b").agg(F.min("a").alias("m"))
        linked = small.join(least, "b")
        after = linked.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(linked.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        after = written(after, "links")
        forget(now)
        # A forest of stars: no node is both a centre and a leaf, and no leaf has two centres.
        ends = after.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("n"), F.lit(1).alias("leaf")))).alias("e")).select("e.*")
        if ends.groupBy("n").agg(F.min("leaf").alias("centre"), F.sum("leaf").alias("leaf")).where("leaf > 1 or (centre = 0 and leaf > 0)").isEmpty():
            return after.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(after.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        now = after
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
