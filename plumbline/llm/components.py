"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: integers); the component is its smallest node.

    Alternates two star steps until all edges point at roots: every node points its larger neighbours,
    then its smaller ones, at the smallest node around it. A step is an aggregate and a join on the node; a
    node with very many neighbours is summed before the shuffle and split in the join by adaptive execution.
    """
    state = stored(_pointed(edges.select("a", "b")), "components")
    while not _settled(state):
        state = stored(_small_star(_large_star(state)).distinct(), "components")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Has every node one edge or only edges towards it?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return counts.where("up > 1 or (up = 1 and down > 0)").isEmpty()


def _pointed(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node."""
    return (
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    joined = edges.join(lowest, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
        lowest.select("a", F.col("low").alias("b"))
    )
    return moved.where("a != b")
