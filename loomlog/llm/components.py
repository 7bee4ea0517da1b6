"""Connected components of links by alternating stars, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hand every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
    least = both.groupBy("node").agg(F.least(F.min("parent"), F.first("node")).alias("least"))
    return (
        both.filter(F.col("parent") > F.col("node")).join(least, "node")
        .select(F.col("parent").alias("node"), F.col("least").alias("parent")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hand the smaller neighbours of a node, and the node, to the smallest of them. Edges point to smaller nodes."""
    least = edges.groupBy("node").agg(F.min("parent").alias("least"))
    moved = edges.join(least, "node").filter(F.col("parent") != F.col("least")).select(
        F.col("parent").alias("node"), F.col("least").alias("parent")
    )
    return moved.unionByName(least.select("node", F.col("least").alias("parent"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for all nodes of ``links`` (``a``, ``b``) but the smallest."""
    edges = stored(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")).distinct(),
        "links",
    )
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        # One row tells whether anything moved.
        seen = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "parent"))).first())
        if seen == before or not seen[0]:
            return edges.withColumnRenamed("parent", "component")
        before = seen
