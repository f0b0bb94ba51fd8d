"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import written


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges (a long, b long)`` reaches.

    Returns ``(node, root)`` for the nodes that are not their own root. Large-star and small-star
    steps alternate until every node points at a root. Each round is written to the shared
    folder, so that a lost executor costs a round and the lineage stays short; the smallest
    neighbour is an aggregate with a partial step, and is joined back, so a node with many
    neighbours is never gathered. Self-loops and repeated edges are allowed; nulls are not
    linked to anything. No edges: no rows.
    """
    spark = edges.sparkSession
    links = _normal(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    links = written(links, "components")
    while True:
        if links.isEmpty():
            return spark.createDataFrame([], "node long, root long")
        parents = links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
        tangled = parents.where("n > 1").select("node").union(
            links.join(parents.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")))
        if tangled.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = written(_small_star(_large_star(links)), "components")


def _normal(links: DataFrame) -> DataFrame:
    """Edges from the larger node to the smaller, each once."""
    return (links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("centre")).agg(F.least(F.min("b"), F.col("centre")).alias("root"))
    around = both.where("b > a").join(least, F.col("a") == F.col("centre"))
    return _normal(around.select(F.col("b").alias("a"), F.col("root").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, are linked to the smallest of them."""
    least = links.groupBy(F.col("a").alias("centre")).agg(F.min("b").alias("root"))
    below = links.join(least, F.col("a") == F.col("centre")).select(F.col("b").alias("a"), F.col("root").alias("b"))
    return _normal(below.unionByName(least.select(F.col("centre").alias("a"), F.col("root").alias("b"))))
