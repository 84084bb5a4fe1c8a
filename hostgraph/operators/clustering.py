"""Directed clustering coefficient of every node of every bucket.

Directed (Fagiolo) clustering, unweighted, self-loops ignored, has a closed form on the
undirected pair multiset: with m(u, v) in {1, 2} the number of directions between u and v,
d(x) = sum of m over x's pairs and b(x) = pairs with m = 2,

    c(x) = sum over triangles {x, y, z} of m(x,y) m(x,z) m(y,z) / (d(d - 1) - 2b),  0 if none.

Triangles are listed with degree ordering: every undirected pair is oriented from the
endpoint of lower (degree, host) to the higher one, wedges are formed only from a node's
*oriented* neighbours (at most sqrt(2E) of them, however large its full degree), and a
wedge is closed by an equi-join on the third pair.  Each triangle is found exactly once,
at its lowest vertex; its weight is credited to all three vertices with one explode and
one aggregation.  Total work O(E^1.5) — no hub emits all pairs of its neighbours.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


PART_PAIRS = 1000


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """(bucket, u, v, m) with u < v, self-loops dropped."""
    return (edges.where(F.col("src") != F.col("dst"))
            .select("bucket", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
            .groupBy("bucket", "u", "v").agg(F.count(F.lit(1)).alias("m")))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """``(bucket, host, clustering_coefficient)`` for every node (self-loop-only nodes: 0).

    The undirected pairs, the degree table and the oriented pair table are each written once
    (reliable checkpoints): wedges, closing pairs and denominators read them instead of
    re-deriving the pairs per reference.  A node with many oriented neighbours (up to the root
    of twice the edges) has its wedges dealt out in parts of ``PART_PAIRS`` first neighbours."""
    und = materialize(undirected_pairs(edges))
    ends = und.select("bucket", F.explode(F.array(
        F.struct(F.col("u").alias("x"), F.col("m")), F.struct(F.col("v").alias("x"), F.col("m")))).alias("e"))
    deg = materialize(ends.groupBy("bucket", F.col("e.x").alias("host")).agg(
        F.count(F.lit(1)).alias("k"),                      # undirected neighbours
        F.sum("e.m").alias("d"),                            # in + out degree, no self-loop
        F.count_if(F.col("e.m") == 2).alias("b")))          # mutual pairs

    ku = deg.select("bucket", F.col("host").alias("u"), F.col("k").alias("ku"))
    kv = deg.select("bucket", F.col("host").alias("v"), F.col("k").alias("kv"))
    o = und.join(ku, ["bucket", "u"]).join(kv, ["bucket", "v"])
    low_u = F.struct("ku", "u") < F.struct("kv", "v")
    oriented = materialize(o.select(
        "bucket", "u", "v", "m",
        F.when(low_u, F.col("u")).otherwise(F.col("v")).alias("x"),
        F.when(low_u, F.col("v")).otherwise(F.col("u")).alias("y")))
    parts = (oriented.groupBy("bucket", "x")
             .agg(F.ceil(F.count(F.lit(1)) / PART_PAIRS).cast("int").alias("parts")))
    dealt = oriented.join(parts, ["bucket", "x"])
    a = dealt.select("bucket", "x", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"),
                     F.col("y").alias("y1"), F.col("m").alias("m1"))
    b = dealt.select("bucket", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                     F.col("y").alias("y2"), F.col("m").alias("m2"))
    wedges = a.join(b, ["bucket", "x", "part"]).where(F.col("y1") < F.col("y2"))
    closing = oriented.select("bucket", F.col("u").alias("y1"), F.col("v").alias("y2"), F.col("m").alias("m3"))
    tri = wedges.join(closing, ["bucket", "y1", "y2"])
    t = F.col("m1") * F.col("m2") * F.col("m3")
    credit = (tri.select("bucket", t.alias("t"), F.explode(F.array("x", "y1", "y2")).alias("host"))
              .groupBy("bucket", "host").agg(F.sum("t").alias("tw")))

    nodes = edges.select("bucket", F.explode(F.array("src", "dst")).alias("host")).distinct()
    denom = F.col("d") * (F.col("d") - 1) - 2 * F.col("b")
    return (nodes.join(deg, ["bucket", "host"], "left").join(credit, ["bucket", "host"], "left")
            .select("bucket", "host",
                    F.when(F.col("tw").isNull() | (denom <= 0), F.lit(0.0))
                    .otherwise(F.col("tw") / denom).alias("clustering_coefficient")))
