"""Connected components of an edge table by alternating star rewrites.

Large-star hangs every larger neighbour of a node on its smallest neighbour, small-star every
smaller one; both only need a partially aggregated minimum per node and a join with it, so the
neighbours of a hub are never gathered.  The edge table is written after each round and the one
before it deleted; the number of rounds grows with the logarithm of the longest path.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_table, write_table


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return (e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """``node, component`` (the smallest node of its component) for every node with an edge.

    ``edges`` has two long columns ``u, v`` in any order; loops, repeated edges and null ends
    are ignored.  Returns the written table and its folder."""
    spark = edges.sparkSession
    e, path = write_table(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges")
    while True:
        # finished: a forest of depth one
        tails = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        heads = e.select(F.col("v").alias("u")).distinct().withColumn("head", F.lit(True))
        if not tails.join(heads, "u", "left").where("n > 1 OR head").limit(1).count():
            break
        step, half = write_table(_large_star(e).distinct(), "edges")
        drop_table(spark, path)
        e, path = write_table(_small_star(step).distinct(), "edges")
        drop_table(spark, half)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out, kept = write_table(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots),
                            "components")
    drop_table(spark, path)
    return out, kept
