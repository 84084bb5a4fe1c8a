"""Mergeable summaries: quantiles (KLL) and distinct counts with overlaps (theta), one row per group
(SURVEY B9, B10, M6 beside their exact forms).

One pass writes a small row per day (or file); any set of days is then answered by merging rows, without
reading a flow.  Sketches are Spark's built-in aggregates: partially aggregated, of fixed size, no shuffle of values.
Bounds: a quantile's rank is off by at most ``RANK_ERROR`` (twice the 99 % bound of a KLL sketch of ``KLL_K``);
distinct counts are exact up to ``2^THETA_LOG`` keys and else within ``COUNT_ERROR`` (three standard
deviations); an overlap is within ``COUNT_ERROR`` of the union's size.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KLL_K = 400
RANK_ERROR = 0.015
THETA_LOG = 12
COUNT_ERROR = 0.05


def summarise(df: DataFrame, group: str, numbers: list[str], keys: list[str]) -> DataFrame:
    """One row per group: ``n`` rows, ``<column>_quantiles`` of the numbers (missing, NaN and infinite values have
    no say) and ``<key>_distinct`` of the keys (NULL is no key)."""
    inf = F.lit(float("inf"))
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < inf), F.col(c).cast("double"))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.kll_sketch_agg_double(real(c), KLL_K).alias(f"{c}_quantiles") for c in numbers],
        *[F.theta_sketch_agg(F.col(k).cast("string"), THETA_LOG).alias(f"{k}_distinct") for k in keys])


def merge(summaries: DataFrame, numbers: list[str], keys: list[str]) -> DataFrame:
    """The summaries of several groups as one row."""
    return summaries.agg(
        F.sum("n").alias("n"), *[F.kll_merge_agg_double(f"{c}_quantiles").alias(f"{c}_quantiles") for c in numbers],
        *[F.theta_union_agg(f"{k}_distinct").alias(f"{k}_distinct") for k in keys])


def quantile(column: str, p: float) -> F.Column:
    """The p-quantile of a number from its summary; NULL without values."""
    s = F.col(f"{column}_quantiles")
    return F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, F.lit(p)))


def distinct(key: str) -> F.Column:
    return F.theta_sketch_estimate(f"{key}_distinct")


def overlap(a: F.Column, b: F.Column) -> F.Column:
    """How many keys two summaries share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def rank_within(df: DataFrame, group: str, column: str, asked: DataFrame) -> DataFrame:
    """``group, p, n, within`` for the rows ``group, p, value`` of ``asked``: whether the value's exact ranks reach
    within ``RANK_ERROR`` of p (equal values share a span of ranks).  One scan of the flows."""
    v = F.col(column).cast("double")
    j = df.where(v.isNotNull() & ~F.isnan(v)).select(group, v.alias("v")).join(asked, group)
    n = F.count(F.lit(1))
    low, high = F.count_if(F.col("v") < F.col("value")) / n, F.count_if(F.col("v") <= F.col("value")) / n
    return j.groupBy(group, "p").agg(n.alias("n"), (
        (low <= F.col("p") + RANK_ERROR) & (high >= F.col("p") - RANK_ERROR)).alias("within"))
