"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmart.llm.common import settle


def _star(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)``, v < u, by which every neighbour of a node that is not smaller hangs on the least one."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    # A join of two tables, so that adaptive execution can split the neighbours of a hub.
    return both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, hang on the least of them."""
    least = settle(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node but the least of its component, which is the component's name.

    ``edges`` has columns u and v. Two rounds of stars at a time are written, until nothing moves: about as many
    rounds as the logarithm of the longest chain. No task holds a component.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        after = settle(_small_star(settle(_star(now).distinct())).distinct())
        # A star in which each node hangs on a node that hangs on nothing stays as it is.
        hanging = after.select(F.col("u").alias("node"))
        done = after.join(hanging, after["v"] == hanging["node"], "left_semi").limit(1).count() == 0
        done = done and after.groupBy("u").count().where("count > 1").limit(1).count() == 0
        now = after
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
