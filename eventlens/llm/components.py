"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventlens.session import settle


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b).

    Every round points larger neighbours of a node at its smallest one, then the node itself and its smaller
    neighbours (large star, small star). Smallest neighbours are aggregated in the map tasks and joined back,
    so a node with many edges is split like any large join key. The graph of a round is a written table.
    """
    now = settle(_ordered(edges.select("a", "b")))
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        # All edges now lead from a larger to a smaller node.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = settle(_ordered(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every larger node has one edge, to a node that has none to a smaller one."""
    ends = F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"))))
    nodes = edges.select(ends).groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return nodes.where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("least") == 0))).isEmpty()


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node to its smaller one."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
