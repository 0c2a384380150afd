"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle), an equi-join
whose hot nodes adaptive execution can split, and a distinct. State between
steps is a reliable checkpoint in the shared folder; nothing is collected but
two sums per step. The number of steps grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm._shared import shared_folder


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b. large: every neighbour above a node meets the
    node's smallest; else every neighbour below it, and the node itself."""
    if large:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # A shuffle of its own: only a join of two plain shuffles has its hot
    # partitions (a node with very many neighbours) split by adaptive execution.
    met = seen.join(least.repartition("u"), "u").select("u", "v", "m")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b; any order).

    The component is its smallest node. Self-links, repeated links and nulls
    are ignored; nodes without a link to another node have no row.
    """
    shared_folder(links.sparkSession)
    edges = (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    mark = None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        edges = _stars(_stars(edges, True), False).checkpoint()
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").distinct())
