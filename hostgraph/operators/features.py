"""Per (bucket, host) graph features with strictly causal per-host baselines.

The analysed pipeline walks the buckets in order and keeps mutable state per host (a set
of destinations seen so far, running mean/variance).  Here every piece of state is a window
that ends at the previous row, so all buckets are computed at once:

* first contact of a pair  = ``min(bucket) over (partition by src, dst)`` on the *edge* table
* running mean / sample std = ``avg`` / ``stddev_samp`` over ``rowsBetween(unbounded, -1)``
* previous bucket's degree  = ``lag`` over the host, kept only when that row is the
  positionally previous bucket of the whole bucket list

Shuffles: edges -> (src, dst) for first contact -> (bucket, host) for the endpoint
aggregate -> (host) for the baselines.  The last two move host-bucket rows only (one per
host and bucket), never flows, so a host with a third of all flows costs one row per bucket.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Regularisers of the z-scores, on each feature's natural scale (fixed values).
ZSCORE_EPS = {
    "fan_out": 1.0,
    "fan_in": 1.0,
    "novelty_score": 0.05,
    "flow_volume": 1.0,
    "byte_volume": 1.0,
}
MIN_OBSERVATIONS = 2

# The names of the thirteen features, in order.
FEATURE_COLUMNS = (
    "fan_out", "fan_in", "pagerank", "clustering_coefficient", "degree_ratio_change",
    "novelty_score", "flow_volume", "byte_volume", "fan_out_zscore", "fan_in_zscore",
    "novelty_zscore", "flow_volume_zscore", "byte_volume_zscore",
)


def mark_first_contact(edges: DataFrame) -> DataFrame:
    """``is_new`` = 1 when this bucket is the first in which src contacted dst."""
    w = Window.partitionBy("src", "dst")
    return edges.withColumn("is_new",
                            (F.col("bucket") == F.min("bucket").over(w)).cast("int"))


def host_bucket_stats(edges: DataFrame) -> DataFrame:
    """fan_out, fan_in, flow_volume, byte_volume and novelty_score per (bucket, host).

    Each edge is emitted once per endpoint (one ``explode``, no union and no second scan)
    and a single partial-then-final aggregation yields the node set and all counts.
    A self-loop counts once on each side, as in a directed simple graph.
    """
    return endpoint_stats(mark_first_contact(edges))


def endpoint_stats(e: DataFrame) -> DataFrame:
    """The same from edges whose first contacts are marked (``is_new``)."""
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("host"), F.lit(1).alias("o"), F.lit(0).alias("i"),
                 F.col("flow_count").alias("fv"), F.col("total_bytes").alias("bv"),
                 F.col("is_new").alias("nw")),
        F.struct(F.col("dst").alias("host"), F.lit(0).alias("o"), F.lit(1).alias("i"),
                 F.lit(0).cast("long").alias("fv"), F.lit(0.0).alias("bv"),
                 F.lit(0).alias("nw")),
    )).alias("e")
    agg = (e.select("bucket", ends)
           .groupBy("bucket", F.col("e.host").alias("host"))
           .agg(F.sum("e.o").cast("long").alias("fan_out"),
                F.sum("e.i").cast("long").alias("fan_in"),
                F.sum("e.fv").cast("long").alias("flow_volume"),
                F.sum("e.bv").alias("byte_volume"),
                F.sum("e.nw").alias("_n_new")))
    return (agg.withColumn("novelty_score",
                           F.when(F.col("fan_out") > 0,
                                  F.col("_n_new") / F.col("fan_out")))
            .drop("_n_new"))


def bucket_index(df: DataFrame) -> DataFrame:
    """Dense position of every distinct bucket.  The table has one row per bucket
    (time span / width rows), so its single-partition window is bounded by the
    calendar, not by the data volume; the join back is left to AQE, which broadcasts
    it from measured size."""
    return (df.select("bucket").distinct()
            .withColumn("bucket_idx", F.row_number().over(Window.orderBy("bucket"))))


def baseline_zscore(value: str, eps: float, frame) -> F.Column:
    """(v - mean of strictly earlier values) / (their sample std + eps); NULL with fewer
    than two earlier observations or when v is NULL.  Aggregates skip NULLs, so a feature
    that is undefined in some buckets only counts the buckets where it was defined."""
    v = F.col(value)
    n = F.count(v).over(frame)
    mean = F.avg(v).over(frame)
    std = F.stddev_samp(v).over(frame)
    return F.when(v.isNotNull() & (n >= MIN_OBSERVATIONS), (v - mean) / (std + F.lit(eps)))


def add_baselines(hb: DataFrame) -> DataFrame:
    """degree_ratio_change and the five z-scores, one window spec (one sort) per host.

    The host-bucket table is written once first: the bucket index and the windows both
    read it, instead of two branches each recomputing scan -> edges -> host aggregate."""
    hb = materialize(hb)
    hb = hb.join(bucket_index(hb), "bucket")
    w = Window.partitionBy("host").orderBy("bucket")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    degree = F.col("fan_in") + F.col("fan_out")
    prev_degree = F.lag(degree).over(w)
    prev_idx = F.lag("bucket_idx").over(w)
    cols = [F.when(prev_idx == F.col("bucket_idx") - 1,
                   degree / prev_degree).alias("degree_ratio_change")]
    for feat, eps in ZSCORE_EPS.items():
        name = "novelty_zscore" if feat == "novelty_score" else f"{feat}_zscore"
        cols.append(baseline_zscore(feat, eps, prior).alias(name))
    return hb.select("*", *cols).drop("bucket_idx")


def host_features(edges: DataFrame, pagerank: DataFrame | None = None,
                  clustering: DataFrame | None = None) -> DataFrame:
    """All 13 features per (bucket, host).  ``pagerank`` / ``clustering`` are
    ``(bucket, host, value)`` frames joined on the same key (co-partitioned)."""
    hb = add_baselines(host_bucket_stats(edges))
    if pagerank is not None:
        hb = hb.join(pagerank, ["bucket", "host"], "left")
    else:
        hb = hb.withColumn("pagerank", F.lit(None).cast("double"))
    if clustering is not None:
        hb = hb.join(clustering, ["bucket", "host"], "left")
    else:
        hb = hb.withColumn("clustering_coefficient", F.lit(None).cast("double"))
    return hb.select("bucket", "host", *FEATURE_COLUMNS)


def top_k(features: DataFrame, by: str, k: int = 10, extra: tuple = ()) -> DataFrame:
    """k largest rows by ``by`` (ties by bucket, host); a TakeOrderedAndProject, no sort
    of the whole table."""
    return (features.where(F.col(by).isNotNull())
            .orderBy(F.col(by).desc(), "bucket", "host")
            .limit(k)
            .select("bucket", "host", *extra, by))
