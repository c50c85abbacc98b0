"""Connected components of a table of links, as joins and aggregates that never gather links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of *links* (a, b) whose component has a smaller node; component is the smallest.

    Alternates two steps until every component is a star: each node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. A hub costs a skewed join at most, which adaptive execution splits.
    """
    edges = saved(_directed(links.select("a", "b")))
    while not _stars(edges):
        both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
        edges = both.filter("low > high").join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low")).distinct()
        least = edges.groupBy("high").agg(F.min("low").alias("least"))
        rest = edges.join(least, "high").filter("low <> least").select(F.col("low").alias("a"), F.col("least").alias("b"))
        edges = saved(_directed(rest.union(least)))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component"))


def _directed(links: DataFrame) -> DataFrame:
    a, b = links.columns
    return links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high <> low").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour and that one has none."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("low", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return nodes.filter("up > 1 OR (up = 1 AND down > 0)").isEmpty()
