"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.session import reliable


def large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = reliable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of every node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = reliable(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: every linked node but the smallest of its component, and that smallest one.

    Minima are written before they are joined back: AQE splits a skewed key only
    if both sides of a join are plain shuffles.

    ``edges`` has columns ``u, v`` of one orderable type, neither null.  Both
    steps only join edges with one minimum per node; each round is written to
    the checkpoint folder, and the number of rounds grows with the logarithm of
    the length of the longest chain.
    """
    edges = reliable(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        edges = reliable(small_star(reliable(large_star(edges))))
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            return edges
        mark = (row["n"], row["h"])
