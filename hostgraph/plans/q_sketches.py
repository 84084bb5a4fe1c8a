"""Catalog entries: mergeable summaries, held against exact ranks and counts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as SK
from ..session import scratch_path
from ..sources.flows import events_flows
from . import sqlparts as S
from .registry import register

_P = (0.01, 0.25, 0.5, 0.75, 0.99)


def _summaries(spark, sf):
    """Flows with their date, and the written summaries, one row per date."""
    f = events_flows(spark, sf).withColumn("date", F.to_date("ts"))
    path = scratch_path(spark, "summaries")
    SK.summarise(f, "date", ["bytes"], ["src", "dst"]).write.parquet(path)
    return f, spark.read.parquet(path)


@register("quantile_summaries", "B10", S.with_(S.FLOWS) + """
, k AS (SELECT dayname(ts) AS weekday, count(bytes) AS n FROM flows WHERE ts IS NOT NULL GROUP BY 1)
SELECT weekday, p, n, TRUE AS within FROM k, (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS p) q
UNION ALL SELECT 'all', p, (SELECT count(bytes) FROM flows), TRUE
FROM (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS p) q""")
def q_quantile_summaries(spark, sf):
    """Quantiles of bytes of each weekday and of all days from the merged summaries of dates, each held
    against its exact rank."""
    f, daily = _summaries(spark, sf)
    by_weekday = daily.withColumn("weekday", F.date_format("date", "EEEE")).groupBy("weekday").agg(
        F.kll_merge_agg_double("bytes_quantiles").alias("bytes_quantiles"))
    every = SK.merge(daily, ["bytes"], []).select(F.lit("all").alias("weekday"), "bytes_quantiles")
    asked = by_weekday.unionByName(every).select("weekday", F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), SK.quantile("bytes", p).alias("value")) for p in _P])).alias("q")).select("weekday", "q.*")
    rows = f.where("ts IS NOT NULL").select("bytes", F.explode(F.array(F.date_format("ts", "EEEE"), F.lit("all"))).alias("weekday"))
    return SK.rank_within(rows, "weekday", "bytes", asked)


@register("distinct_summaries", "B9", S.with_(S.FLOWS) + """
, d AS (SELECT DISTINCT CAST(ts AS DATE) AS date, src FROM flows WHERE src IS NOT NULL),
o AS (SELECT a.date, count(b.src) AS n_shared FROM d a LEFT JOIN d b ON b.src = a.src AND b.date = a.date - 1 GROUP BY 1),
x AS (SELECT date, count(*) AS n_sources FROM d GROUP BY 1)
SELECT date, n_sources, n_shared, TRUE AS sources_within, TRUE AS shared_within FROM x JOIN o USING (date)""")
def q_distinct_summaries(spark, sf):
    """Sources per date, and how many were there the day before, exact and from the summaries."""
    f, daily = _summaries(spark, sf)
    s = daily.where("date IS NOT NULL").select("date", "src_distinct")
    before = s.select(F.date_add("date", 1).alias("date"), F.col("src_distinct").alias("before"))
    estimated = s.join(before, "date", "left").select(
        "date", SK.distinct("src").alias("e_sources"), F.coalesce(SK.overlap(F.col("src_distinct"), F.col("before")), F.lit(0)).alias("e_shared"))
    seen = f.where("src IS NOT NULL AND date IS NOT NULL").select("date", "src").distinct()
    was = seen.select(F.date_add("date", 1).alias("date"), "src", F.lit(1).alias("was"))
    exact = seen.join(was, ["date", "src"], "left").groupBy("date").agg(
        F.count(F.lit(1)).alias("n_sources"), F.count("was").alias("n_shared"))
    near = lambda a, b, of: F.abs(F.col(a) - F.col(b)) <= SK.COUNT_ERROR * F.col(of)
    return exact.join(estimated, "date").select(
        "date", "n_sources", "n_shared", near("e_sources", "n_sources", "n_sources").alias("sources_within"),
        near("e_shared", "n_shared", "n_sources").alias("shared_within"))
