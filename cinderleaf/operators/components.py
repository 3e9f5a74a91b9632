"""Connected components by alternating large and small stars, no node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.session import written


def _with_least(links: DataFrame) -> DataFrame:
    """`links` (u, v) with `least`, the smallest neighbour of u or u itself.

    Both sides of the join are written tables, so that Spark can split the rows of a hot u.
    """
    links = written(links)
    least = written(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")))
    return links.join(least, "u")


def _settled(links: DataFrame) -> bool:
    """Whether `links` (u, v) are stars: every u has one v, and no v is a u."""
    many = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return many.isEmpty() and links.join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the smallest node it reaches.

    The rounds grow with the logarithm of the longest chain; no node's neighbours are ever collected.
    """
    links = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        if _settled(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = _with_least(large)
        links = written(
            small.where("v != least")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(small.select("u", F.col("least").alias("v")))
            .distinct()
        )
