"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

SCHEMA = "node bigint, root bigint"


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links(a, b)``; root is the smallest node of its component.

    Each round first hangs every node's larger neighbours on its smallest one, then every node's
    smaller neighbours. Only the minimum of a node's neighbours is gathered, never their list, and
    the joins on a node are splittable where a node has very many links. Rounds are written tables,
    about log of the longest path of them; the number of links never grows. No links give no rows.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    while True:
        large = _large_star(edges)
        after = materialize(_small_star(large))
        # Stable once every larger end hangs on one root and no root hangs on another.
        if _is_stars(after):
            break
        edges = after
    roots = after.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(smallest.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    linked_twice = edges.groupBy("u").count().where("count > 1")
    chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
    return linked_twice.isEmpty() and chained.isEmpty()
