"""Catalog entries: edge tables, graph summary and host-bucket features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import features as FT
from ..session import materialize
from ..sources.flows import events_flows
from . import sqlparts as S
from .registry import register, rounded

FEATURE_WIDTH = "1 day"     # host features on the events view use day buckets


def flows_edges(spark, sf, width=FEATURE_WIDTH):
    return E.build_edges(events_flows(spark, sf), width)


def flows_features(spark, sf, width=FEATURE_WIDTH, with_graph_measures=True):
    from .host_table import host_feature_table
    return host_feature_table(events_flows(spark, sf), width, with_graph_measures)


_EDGE_COLS = "bucket, src, dst, flow_count, round(total_bytes, 6) AS total_bytes"


@register("edges_hourly", "C1",
          S.with_(S.FLOWS, S.edges("1 hour")) + f"SELECT {_EDGE_COLS} FROM edges")
def q_edges_hourly(spark, sf):
    return rounded(flows_edges(spark, sf, "1 hour"))


@register("edges_5min", "C2",
          S.with_(S.FLOWS, S.edges("5 minutes")) + f"SELECT {_EDGE_COLS} FROM edges")
def q_edges_5min(spark, sf):
    return rounded(flows_edges(spark, sf, "5 minutes"))


@register("graph_summary", "C3,C4", S.with_(S.FLOWS, S.edges("1 hour")) + """
, nodes AS (SELECT DISTINCT bucket, host FROM (SELECT bucket, src AS host FROM edges
                                              UNION ALL SELECT bucket, dst FROM edges) u),
  days AS (SELECT date_trunc('hour', ts) AS bucket, min(day) AS day FROM flows
           WHERE ts IS NOT NULL GROUP BY 1)
SELECT e.bucket, e.n_edges, CAST(e.total_flows AS BIGINT) AS total_flows, n.n_nodes, d.day
FROM (SELECT bucket, count(*) AS n_edges, sum(flow_count) AS total_flows FROM edges GROUP BY 1) e
JOIN (SELECT bucket, count(*) AS n_nodes FROM nodes GROUP BY 1) n USING (bucket)
LEFT JOIN days d USING (bucket)""")
def q_graph_summary(spark, sf):
    ed = materialize(E.build_edges(events_flows(spark, sf), "1 hour", carry={"day": F.min("day")}))
    return E.graph_summary(ed, "day").select("bucket", "n_edges", "total_flows", "n_nodes", "day")


_HB = S.with_(S.FLOWS, S.edges(FEATURE_WIDTH), S.HOST_BUCKET)


@register("fan_degree", "C5,C6", _HB + "SELECT bucket, host, fan_out, fan_in, fan_in + fan_out AS total_degree FROM hb")
def q_fan_degree(spark, sf):
    hb = FT.host_bucket_stats(flows_edges(spark, sf))
    return hb.select("bucket", "host", "fan_out", "fan_in",
                     (F.col("fan_in") + F.col("fan_out")).alias("total_degree"))


@register("out_volume", "C7,C8",
          _HB + "SELECT bucket, host, flow_volume, round(byte_volume, 6) AS byte_volume FROM hb")
def q_out_volume(spark, sf):
    hb = FT.host_bucket_stats(flows_edges(spark, sf))
    return rounded(hb.select("bucket", "host", "flow_volume", "byte_volume"))


@register("novelty_score", "C10",
          _HB + "SELECT bucket, host, round(novelty_score, 6) AS novelty_score FROM hb "
                "WHERE novelty_score IS NOT NULL")
def q_novelty(spark, sf):
    hb = FT.host_bucket_stats(flows_edges(spark, sf))
    return rounded(hb.where(F.col("novelty_score").isNotNull())
                   .select("bucket", "host", "novelty_score"))


_HF = S.with_(S.FLOWS, S.edges(FEATURE_WIDTH), S.HOST_BUCKET, S.BASELINES)


@register("degree_ratio_change", "C9",
          _HF + "SELECT bucket, host, round(degree_ratio_change, 6) AS degree_ratio_change FROM hf")
def q_degree_ratio(spark, sf):
    hf = FT.add_baselines(FT.host_bucket_stats(flows_edges(spark, sf)))
    return rounded(hf.select("bucket", "host", "degree_ratio_change"))


@register("running_stats", "C13", _HB + """
SELECT bucket, host,
       count(flow_volume) OVER p AS n_prior,
       round(avg(flow_volume) OVER p, 6) AS prior_mean,
       round(stddev_samp(flow_volume) OVER p, 6) AS prior_std
FROM hb
WINDOW p AS (PARTITION BY host ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_running_stats(spark, sf):
    from pyspark.sql import Window
    hb = FT.host_bucket_stats(flows_edges(spark, sf))
    p = Window.partitionBy("host").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return rounded(hb.select("bucket", "host",
                             F.count("flow_volume").over(p).alias("n_prior"),
                             F.avg("flow_volume").over(p).alias("prior_mean"),
                             F.stddev_samp("flow_volume").over(p).alias("prior_std")))


_ZCOLS = ("fan_out_zscore", "fan_in_zscore", "novelty_zscore", "flow_volume_zscore",
          "byte_volume_zscore")


@register("zscores", "C14,C15",
          _HF + "SELECT bucket, host, " + ", ".join(S.r6(c) for c in _ZCOLS) + " FROM hf")
def q_zscores(spark, sf):
    hf = FT.add_baselines(FT.host_bucket_stats(flows_edges(spark, sf)))
    return rounded(hf.select("bucket", "host", *_ZCOLS))


@register("online_features", "C9,C10,C13-C15 (carried forward)",
          _HF + "SELECT bucket, host, fan_out, fan_in, flow_volume, round(byte_volume, 6) AS byte_volume, "
          "round(novelty_score, 6) AS novelty_score, round(degree_ratio_change, 6) AS degree_ratio_change, "
          + ", ".join(S.r6(c) for c in _ZCOLS) + " FROM hf")
def q_online_features(spark, sf):
    """The day buckets fed in batches of a week to the state that is carried forward; no batch reads the
    edges of another."""
    from ..operators.online import OnlineFeatures
    from ..session import scratch_path
    from ..sources import sinks
    path = scratch_path(spark, "online-edges")
    edges = flows_edges(spark, sf).withColumn("week", F.date_trunc("week", "bucket").cast("date"))
    sinks.write_parquet(edges, path, ("week",))
    stored = sinks.read_parquet(spark, path)
    online = OnlineFeatures(spark, scratch_path(spark, "online-state"))
    # one step per week of the calendar, in its order
    for week, in stored.select("week").distinct().orderBy("week").collect():
        online.advance(stored.where(F.col("week") == F.lit(week)).drop("week"))
    return rounded(online.features())


def _top_sql(by: str, extra: str) -> str:
    shown = S.r6(by) if by.endswith("zscore") else by
    return (_HF + f"SELECT bucket, host, {extra}{shown} FROM hf WHERE {by} IS NOT NULL "
            f"ORDER BY {by} DESC, bucket, host LIMIT 10")


@register("top_fan_out", "C17", _top_sql("fan_out", "fan_in, "))
def q_top_fan_out(spark, sf):
    hf = FT.add_baselines(FT.host_bucket_stats(flows_edges(spark, sf)))
    return rounded(FT.top_k(hf, "fan_out", 10, ("fan_in",)))


@register("top_fan_out_z", "C17", _top_sql("fan_out_zscore", "fan_out, "))
def q_top_fan_out_z(spark, sf):
    hf = FT.add_baselines(FT.host_bucket_stats(flows_edges(spark, sf)))
    return rounded(FT.top_k(hf, "fan_out_zscore", 10, ("fan_out",)))


@register("top_volume_z", "C17", _top_sql("flow_volume_zscore", "flow_volume, "))
def q_top_volume_z(spark, sf):
    hf = FT.add_baselines(FT.host_bucket_stats(flows_edges(spark, sf)))
    return rounded(FT.top_k(hf, "flow_volume_zscore", 10, ("flow_volume",)))


@register("pagerank", "C11", S.with_(S.FLOWS, S.edges(FEATURE_WIDTH), S.pagerank_ctes())
          + "SELECT bucket, host, round(pagerank, 6) AS pagerank FROM pr")
def q_pagerank(spark, sf):
    from ..operators.pagerank import pagerank
    return rounded(pagerank(materialize(flows_edges(spark, sf))))


@register("clustering", "C12", S.with_(S.FLOWS, S.edges(FEATURE_WIDTH), S.CLUSTERING)
          + "SELECT bucket, host, round(clustering_coefficient, 6) AS clustering_coefficient FROM cc")
def q_clustering(spark, sf):
    from ..operators.clustering import clustering_coefficient
    return rounded(clustering_coefficient(materialize(flows_edges(spark, sf))))


@register("lineitem_host_features", "C1,C5-C10,C13-C15 (lineitem view)",
          S.with_("""flows AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, 's' || CAST(l_suppkey AS VARCHAR) AS src,
         'p' || CAST(l_partkey AS VARCHAR) AS dst, l_shipdate AS ts, l_extendedprice AS bytes FROM lineitem)""",
                  S.edges("month"), S.HOST_BUCKET, S.BASELINES)
          + "SELECT bucket, host, fan_out, fan_in, flow_volume, round(byte_volume, 6) AS byte_volume, "
          + "round(novelty_score, 6) AS novelty_score, round(degree_ratio_change, 6) AS degree_ratio_change, "
          + ", ".join(S.r6(c) for c in _ZCOLS) + " FROM hf")
def q_lineitem_host_features(spark, sf):
    """Supplier -> part shipments, monthly buckets: the larger, many-ties flow view."""
    from ..sources.flows import lineitem_flows
    hf = FT.add_baselines(FT.host_bucket_stats(E.build_edges(lineitem_flows(spark, sf), "month")))
    return rounded(hf.select("bucket", "host", "fan_out", "fan_in", "flow_volume", "byte_volume",
                             "novelty_score", "degree_ratio_change", *_ZCOLS))


_SNAPSHOT = S.with_(S.FLOWS, S.edges("1 hour")) + (
    "SELECT bucket, src, dst, flow_count, round(total_bytes, 6) AS total_bytes FROM edges")


def _edge_snapshot(spark, sf):
    from ..session import scratch_path
    from ..sources import sinks
    ed = flows_edges(spark, sf, "1 hour").withColumn("day", F.date_format("bucket", "EEEE"))
    path = scratch_path(spark, "edge-snapshot")
    sinks.write_parquet(ed, path, ("day",))
    return sinks.read_parquet(spark, path)


@register("edge_snapshot", "A8", _SNAPSHOT)
def q_edge_snapshot(spark, sf):
    """Hourly edge table written partitioned by weekday and read back."""
    return rounded(_edge_snapshot(spark, sf).select("bucket", "src", "dst", "flow_count", "total_bytes"))


@register("edge_snapshot_day", "A8", _SNAPSHOT + " WHERE dayname(bucket) = 'Friday'")
def q_edge_snapshot_day(spark, sf):
    """The same table asked for one day: only that folder is listed and scanned."""
    return rounded(_edge_snapshot(spark, sf).where(F.col("day") == "Friday")
                   .select("bucket", "src", "dst", "flow_count", "total_bytes"))


@register("report_sink", "A10", _top_sql("flow_volume_zscore", "flow_volume, "))
def q_report_sink(spark, sf):
    """The top flow-volume report written as a one-file JSON report (a small aggregate by
    construction) and read back with its schema."""
    from ..session import scratch_path
    from ..sources import sinks
    hf = FT.add_baselines(FT.host_bucket_stats(flows_edges(spark, sf)))
    report = rounded(FT.top_k(hf, "flow_volume_zscore", 10, ("flow_volume",)))
    path = scratch_path(spark, "report-top-volume")
    sinks.write_report(report, path, "json", ("bucket", "host"))
    return spark.read.schema(report.schema).json(path)
