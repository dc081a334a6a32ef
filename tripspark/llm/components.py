"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties the smaller neighbours of a node, and the node, to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(smallest.select("u", F.col("m").alias("v"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each child has one parent and no parent is a child; one pass over both ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("parents"), F.lit(False).alias("is_parent")).union(
        edges.select("v", F.lit(0), F.lit(True))
    )
    nodes = ends.groupBy("node").agg(F.sum("parents").alias("parents"), F.max("is_parent").alias("is_parent"))
    chained = (F.col("parents") > 1) | ((F.col("parents") == 1) & F.col("is_parent"))
    return nodes.agg(F.count_if(chained)).first()[0] == 0


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node of a link; component is the smallest node that links reach.

    Each round is written to the shared folder, so a lost executor costs one round. Links from a node to itself
    and links with a null end are ignored; repeated links count once; no links give no rows.
    """
    whole = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = whole.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialize(edges.where("u <> v").distinct(), "links")
    while not _is_star_forest(edges):
        # The large star makes a row of each edge at most; its repeated rows go with those of the small star.
        edges = materialize(_small_star(_large_star(edges)), "stars")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
