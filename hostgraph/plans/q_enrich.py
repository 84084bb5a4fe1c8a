"""Catalog entries: the full host-feature table, enrichment, audits (SURVEY C16, J1-J2, J6,
B10, B11, P12)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as EN
from ..operators import metrics as M
from ..operators.edges import with_bucket
from ..operators.features import FEATURE_COLUMNS
from ..sources.flows import events_flows
from . import sqlparts as S
from . import stages as ST
from .q_graph import FEATURE_WIDTH, flows_features
from .q_splits import scored
from .registry import register, rounded

_INT_FEATURES = ("fan_out", "fan_in", "flow_volume")


def _r(c: str, prefix: str = "") -> str:
    return f"{prefix}{c}" if c in _INT_FEATURES else f"round({prefix}{c}, 6) AS {prefix}{c}"


_FULL = (S.with_(S.FLOWS, S.edges(FEATURE_WIDTH), S.HOST_BUCKET, S.BASELINES, S.pagerank_ctes(),
                 S.CLUSTERING) + """
, feat AS (SELECT hf.*, pr.pagerank, cc.clustering_coefficient
           FROM hf LEFT JOIN pr USING (bucket, host) LEFT JOIN cc USING (bucket, host))""")


@register("host_features", "C16", _FULL + "SELECT bucket, host, "
          + ", ".join(_r(c) for c in FEATURE_COLUMNS) + " FROM feat")
def q_host_features(spark, sf):
    """The host-feature stage (computed once per session and written, like the stage
    file of the analysed pipeline)."""
    return rounded(ST.host_features(spark, sf))


@register("host_timeline", "P12", _FULL + """
SELECT bucket, fan_out, round(fan_out_zscore, 6) AS fan_out_zscore, round(novelty_score, 6) AS novelty_score,
       round(novelty_zscore, 6) AS novelty_zscore, flow_volume, round(flow_volume_zscore, 6) AS flow_volume_zscore
FROM feat WHERE host = '192.168.10.8'""")
def q_host_timeline(spark, sf):
    f = flows_features(spark, sf, with_graph_measures=False)
    return rounded(f.where(F.col("host") == "192.168.10.8").orderBy("bucket")
                   .select("bucket", "fan_out", "fan_out_zscore", "novelty_score", "novelty_zscore",
                           "flow_volume", "flow_volume_zscore"))


def _side_cols(alias: str, prefix: str) -> str:
    return ", ".join(f"{alias}.{c} AS {prefix}{c}" if c in _INT_FEATURES
                     else f"round({alias}.{c}, 6) AS {prefix}{c}" for c in FEATURE_COLUMNS)


_ENRICH_SQL = _FULL + f"""
, fl AS (SELECT row_id, src, dst, date_trunc('day', ts) AS bucket FROM flows)
SELECT fl.row_id, {_side_cols("s", "src_")}, {_side_cols("d", "dst_")}
FROM fl LEFT JOIN feat s ON s.bucket = fl.bucket AND s.host = fl.src
        LEFT JOIN feat d ON d.bucket = fl.bucket AND d.host = fl.dst"""


def enriched(spark, sf, with_graph_measures=True):
    fl = with_bucket(events_flows(spark, sf), FEATURE_WIDTH)
    feats = (ST.host_features(spark, sf) if with_graph_measures
             else flows_features(spark, sf, with_graph_measures=False))
    return EN.enrich_flows(fl, feats)


@register("enrich_flows", "J1", _ENRICH_SQL)
def q_enrich_flows(spark, sf):
    e = enriched(spark, sf)
    return rounded(e.select("row_id", *[f"{p}{c}" for p in ("src_", "dst_") for c in FEATURE_COLUMNS]))


@register("enrich_guard", "J2", S.with_(S.FLOWS, S.edges(FEATURE_WIDTH), S.HOST_BUCKET) + """
SELECT 'n_duplicate_keys' AS metric,
       (SELECT count(*) FROM (SELECT bucket, host FROM hb GROUP BY 1, 2 HAVING count(*) > 1) d) AS value
UNION ALL SELECT 'n_flows', (SELECT count(*) FROM flows)
UNION ALL SELECT 'n_enriched', (SELECT count(*) FROM flows f
    LEFT JOIN hb s ON s.bucket = date_trunc('day', f.ts) AND s.host = f.src
    LEFT JOIN hb d ON d.bucket = date_trunc('day', f.ts) AND d.host = f.dst)""")
def q_enrich_guard(spark, sf):
    """Row-count guard of the enrichment: duplicate feature keys (must be 0) and flow
    counts before / after; three one-row aggregates stacked as (metric, value) rows."""
    feats = flows_features(spark, sf, with_graph_measures=False)
    fl = with_bucket(events_flows(spark, sf), FEATURE_WIDTH)
    dup = EN.feature_key_guard(feats).agg(F.count(F.lit(1)).alias("value"))
    n = fl.agg(F.count(F.lit(1)).alias("value"))
    ne = EN.enrich_flows(fl, feats).agg(F.count(F.lit(1)).alias("value"))
    return (dup.select(F.lit("n_duplicate_keys").alias("metric"), "value")
            .unionByName(n.select(F.lit("n_flows").alias("metric"), "value"))
            .unionByName(ne.select(F.lit("n_enriched").alias("metric"), "value")))


@register("join_null_audit", "B11", S.with_(S.FLOWS, S.edges(FEATURE_WIDTH), S.HOST_BUCKET) + """
SELECT count(*) AS n_flows, count_if(s.fan_out IS NULL) AS n_missing_src, count_if(d.fan_out IS NULL) AS n_missing_dst
FROM flows f LEFT JOIN hb s ON s.bucket = date_trunc('day', f.ts) AND s.host = f.src
             LEFT JOIN hb d ON d.bucket = date_trunc('day', f.ts) AND d.host = f.dst""")
def q_join_null_audit(spark, sf):
    return EN.join_null_audit(enriched(spark, sf, with_graph_measures=False))


_DESCRIBED = [c for c in FEATURE_COLUMNS]


@register("describe_features", "B10", _FULL + "\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM feat""" for c in _DESCRIBED))
def q_describe_features(spark, sf):
    return rounded(EN.describe(ST.host_features(spark, sf), _DESCRIBED))


@register("regime_comparison", "J6", S.with_(S.FLOWS) + """
, r AS (SELECT label, CASE WHEN label IS NOT DISTINCT FROM 'BENIGN' THEN 0 ELSE 1 END AS y, bytes FROM flows),
  rates AS (SELECT label,
     round(CASE WHEN label = 'BENIGN' THEN 1 - avg(CAST(bytes > 50 AS INTEGER)) ELSE avg(CAST(bytes > 50 AS INTEGER)) END, 6) AS recall_rule_50,
     round(CASE WHEN label = 'BENIGN' THEN 1 - avg(CAST(bytes > 100 AS INTEGER)) ELSE avg(CAST(bytes > 100 AS INTEGER)) END, 6) AS recall_rule_100,
     round(CASE WHEN label = 'BENIGN' THEN 1 - avg(CAST(bytes > 200 AS INTEGER)) ELSE avg(CAST(bytes > 200 AS INTEGER)) END, 6) AS recall_rule_200
   FROM r GROUP BY 1)
SELECT * FROM rates""")
def q_regime_comparison(spark, sf):
    runs = {}
    for t in (50, 100, 200):
        runs[t] = (M.recall_per_class(scored(spark, sf, float(t)))
                   .select("label", F.col("recall").alias(f"recall_rule_{t}")))
    out = runs[50].join(runs[100], "label", "full_outer").join(runs[200], "label", "full_outer")
    return rounded(out)


_FULL_5MIN = (S.with_(S.FLOWS, S.edges("5 minutes"), S.HOST_BUCKET, S.BASELINES, S.pagerank_ctes(),
                      S.CLUSTERING) + """
, feat AS (SELECT hf.*, pr.pagerank, cc.clustering_coefficient
           FROM hf LEFT JOIN pr USING (bucket, host) LEFT JOIN cc USING (bucket, host))""")


@register("host_features_5min", "C2,C16", _FULL_5MIN + "SELECT bucket, host, "
          + ", ".join(_r(c) for c in FEATURE_COLUMNS) + " FROM feat")
def q_host_features_5min(spark, sf):
    """All 13 features at 5-minute resolution (the fine-grained variant)."""
    return rounded(ST.host_features(spark, sf, "5 minutes"))


def _full(width: str) -> str:
    return S.with_(S.FLOWS, S.edges(width), S.HOST_BUCKET, S.BASELINES, S.pagerank_ctes(), S.CLUSTERING) + """
, feat AS (SELECT hf.*, pr.pagerank, cc.clustering_coefficient
           FROM hf LEFT JOIN pr USING (bucket, host) LEFT JOIN cc USING (bucket, host))"""


@register("host_features_hourly", "C1,C16", _full("1 hour") + "SELECT bucket, host, "
          + ", ".join(_r(c) for c in FEATURE_COLUMNS) + " FROM feat")
def q_host_features_hourly(spark, sf):
    """All 13 features per host and hour."""
    return rounded(ST.host_features(spark, sf, "1 hour"))


@register("enrich_flows_hourly", "J1", _full("1 hour") + f"""
, fl AS (SELECT row_id, src, dst, date_trunc('hour', ts) AS bucket FROM flows)
SELECT fl.row_id, {_side_cols("s", "src_")}, {_side_cols("d", "dst_")}
FROM fl LEFT JOIN feat s ON s.bucket = fl.bucket AND s.host = fl.src
        LEFT JOIN feat d ON d.bucket = fl.bucket AND d.host = fl.dst""")
def q_enrich_flows_hourly(spark, sf):
    e = ST.enriched_flows(spark, sf, "1 hour")
    return rounded(e.select("row_id", *[f"{p}{c}" for p in ("src_", "dst_") for c in FEATURE_COLUMNS]))
