"""Connected components of an undirected graph, as DataFrame rounds over written tables.

Alternating large-star and small-star rounds (Kiveris et al., "Connected components in MapReduce and
beyond", SoCC 2014): every round keeps the components, moves all nodes towards the smallest one, and
ends with one star per component. Nothing is collected but whether a round was the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) with a > b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour.

    Only nodes with a smaller neighbour change anything, so the centre of a star, which has the most
    edges, is never looked up successfully and its edges pass unchanged.
    """
    low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    return edges.join(low, edges.b == low.node, "left").select("a", F.coalesce("low", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the smallest of them."""
    low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    linked = edges.join(low, edges.a == low.node).select("a", "b", "low")
    return linked.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, ``component`` being the smallest node it reaches.

    ``edges`` has columns a and b of one orderable type; loops, repeats and either direction are
    fine, rows with a null end are ignored. No edge: an empty table.
    """
    now = scratch.table(_ordered(edges.select("a", "b")), f"{name}-0")
    for k in range(1, rounds + 1):
        if _settled(now):
            break
        middle = scratch.table(_ordered(_large_star(now)), f"{name}-{k}-large")
        now = scratch.table(_ordered(_small_star(middle)), f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large")
        scratch.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    heads = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself: one star for each component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    nodes = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return nodes.where("low > 1 or (low > 0 and high > 0)").isEmpty()
