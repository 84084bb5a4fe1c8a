"""Attach host-bucket features to both ends of every flow.

The two feature lookups ((bucket, src) and (bucket, dst)) are done on the distinct
(bucket, src, dst) keys of the flows — the edge table, found with a partial aggregation —
and the enriched keys are joined to the flows once, null-safe.  The flow table is
therefore shuffled once instead of once per endpoint.  The feature side has exactly one
row per key (checked by ``feature_key_guard``), so every flow is kept exactly once.  AQE
picks broadcast or sort-merge joins from measured sizes and splits partitions that a hot
pair makes skewed (the key side of a hot pair is one row, so replicating it is free).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURE_COLUMNS


def side(features: DataFrame, host_as: str, prefix: str, cols=FEATURE_COLUMNS) -> DataFrame:
    return features.select("bucket", F.col("host").alias(host_as),
                           *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def enrich_keys(keys: DataFrame, features: DataFrame, src: str = "src", dst: str = "dst",
                cols=FEATURE_COLUMNS) -> DataFrame:
    """(bucket, src, dst) keys with both endpoints' features (two left lookups)."""
    return (keys.join(side(features, src, "src_", cols), ["bucket", src], "left")
            .join(side(features, dst, "dst_", cols), ["bucket", dst], "left"))


def enrich_flows(flows: DataFrame, features: DataFrame, src: str = "src", dst: str = "dst",
                 cols=FEATURE_COLUMNS) -> DataFrame:
    """``flows`` must carry ``bucket`` built with the same width as ``features``."""
    keys = flows.select("bucket", src, dst).distinct()
    ek = enrich_keys(keys, features, src, dst, cols)
    ek = ek.select(*[F.col(c).alias(f"_k_{c}") for c in ("bucket", src, dst)],
                   *[c for c in ek.columns if c not in ("bucket", src, dst)])
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("bucket", src, dst)]
    return flows.join(ek, on, "left").drop(*[f"_k_{c}" for c in ("bucket", src, dst)])


def feature_key_guard(features: DataFrame) -> DataFrame:
    """Keys of the feature table that occur more than once (must be empty)."""
    return (features.groupBy("bucket", "host").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def join_null_audit(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count(F.lit(1)).alias("n_flows"),
                        F.count_if(F.col("src_fan_out").isNull()).alias("n_missing_src"),
                        F.count_if(F.col("dst_fan_out").isNull()).alias("n_missing_dst"))


def describe(df: DataFrame, cols: list[str], key: tuple = ("bucket", "host")) -> DataFrame:
    """count / mean / std / min / quartiles / max per column, in long form (one row per
    column).  Moments come from one partial aggregation; quartiles are exact (linear
    interpolation between order statistics) from the distributed ``exact_quantiles``, so
    no column's values are ever gathered in one task."""
    from .scan import exact_quantiles
    long = df.select(*key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("x")).select(*key, "x.*")
    moments = long.groupBy("feature").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(long, "feature", "v", list(key))
    qw = q.groupBy("feature").agg(*[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n)
                                    for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return (moments.join(qw, "feature", "left")
            .select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))
