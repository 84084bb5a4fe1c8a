"""Catalog entries: splits, sampling and metrics over a stand-in detector.

The stand-in detector is a fixed rule (flagged = bytes > 100) so every metric has an exact
SQL oracle; the Spark ML models feed the same metric functions in ``q_models``.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import binary_label
from ..operators import metrics as M
from ..operators import splits as SP
from ..operators.edges import with_bucket
from ..sources.flows import FLAG_BYTES_THRESHOLD, events_flows
from . import sqlparts as S
from .registry import register, rounded

_F = S.with_(S.FLOWS)
_MD5 = "md5('42|' || CAST(row_id AS VARCHAR))"


def scored(spark, sf, threshold=FLAG_BYTES_THRESHOLD):
    f = events_flows(spark, sf)
    return f.select("*", binary_label("label").alias("y"),
                    (F.col("bytes") > threshold).cast("int").alias("pred"))


_SCORED = S.with_(S.FLOWS, """scored AS (
  SELECT *, CASE WHEN label IS NOT DISTINCT FROM 'BENIGN' THEN 0 ELSE 1 END AS y,
         CAST(bytes > 100 AS INTEGER) AS pred FROM flows)""")


@register("split_stratified", "S1", _F + f"""
SELECT label, rn <= round_even(n * 0.2, 0) AS is_test, count(*) AS n
FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY {_MD5}, row_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM flows) r GROUP BY 1, 2""")
def q_split_stratified(spark, sf):
    s = SP.stratified_split(events_flows(spark, sf), ["label"], "row_id", 0.2, 42)
    return s.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("split_stratified_rows", "S1", _F + f"""
SELECT row_id, label FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {_MD5}, row_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n FROM flows) r
WHERE rn <= round_even(n * 0.2, 0)""")
def q_split_stratified_rows(spark, sf):
    s = SP.stratified_split(events_flows(spark, sf), ["label"], "row_id", 0.2, 42)
    return s.where("is_test").select("row_id", "label")


@register("holdout_benign", "S2", _F + f"""
SELECT row_id FROM (
  SELECT row_id, row_number() OVER (ORDER BY {_MD5}, row_id) AS rn, count(*) OVER () AS n
  FROM flows WHERE label = 'BENIGN') r
WHERE rn <= round_even(n * 0.1, 0)""")
def q_holdout_benign(spark, sf):
    h = SP.holdout_class(events_flows(spark, sf), "label", "BENIGN", "row_id", 0.1, 42)
    return h.where("is_holdout").select("row_id")


@register("split_group", "S4", _F + """
SELECT bucket, rn <= greatest(1, round_even(n * 0.2, 0)) AS is_test FROM (
  SELECT bucket, row_number() OVER (ORDER BY md5('42|' || strftime(bucket, '%Y-%m-%d %H:%M:%S')), bucket) AS rn,
         count(*) OVER () AS n
  FROM (SELECT DISTINCT date_trunc('hour', ts) AS bucket FROM flows) b) r""")
def q_split_group(spark, sf):
    f = with_bucket(events_flows(spark, sf), "1 hour")
    f = f.withColumn("bucket_key", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))
    g = SP.group_split(f, "bucket_key", 0.2, 42)
    return g.select("bucket", "is_test").distinct()


@register("stratified_sample", "S6", _F + f"""
SELECT row_id, label FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {_MD5}, row_id) AS rn
  FROM flows WHERE day IN ('Thursday', 'Friday')) r WHERE rn <= 500""")
def q_stratified_sample(spark, sf):
    f = events_flows(spark, sf).where(F.col("day").isin(*SP.TEST_DAYS))
    return SP.stratified_sample(f, "label", 500, "row_id", 42).select("row_id", "label")


@register("loco_folds", "S5", _F + f"""
, hb AS (SELECT row_id, label, CASE WHEN label = 'BENIGN'
           THEN row_number() OVER (PARTITION BY label ORDER BY {_MD5}, row_id)
                > round_even(count(*) OVER (PARTITION BY label) * 0.1, 0) ELSE FALSE END AS is_benign_train
         FROM flows),
  per AS (SELECT label, count(*) AS n, count_if(is_benign_train) AS n_btrain FROM hb GROUP BY 1),
  tot AS (SELECT sum(CASE WHEN label = 'BENIGN' THEN n_btrain END) AS bt,
                 sum(CASE WHEN label IS DISTINCT FROM 'BENIGN' THEN n END) AS att FROM per)
SELECT label AS held_out_class, CAST(bt + att - n AS BIGINT) AS n_train, n AS n_test
FROM per, tot WHERE label IS DISTINCT FROM 'BENIGN'""")
def q_loco_folds(spark, sf):
    f = events_flows(spark, sf)
    h = SP.holdout_class(f, "label", "BENIGN", "row_id", 0.1, 42)
    h = h.withColumn("is_benign_train", F.col("label").eqNullSafe("BENIGN") & ~F.col("is_holdout"))
    return SP.loco_fold_sizes(h, "label", "BENIGN", "is_benign_train")


@register("f1_binary", "M9", _SCORED + """
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p,
                CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r
      FROM (SELECT count_if(y = 1 AND pred = 1) AS tp, count_if(y = 0 AND pred = 1) AS fp,
                   count_if(y = 1 AND pred = 0) AS fn, count_if(y = 0 AND pred = 0) AS tn
            FROM scored) c) m""")
def q_f1_binary(spark, sf):
    return rounded(M.f1_binary(scored(spark, sf)))


@register("classification_report", "M10", _SCORED + """
, named AS (SELECT CASE WHEN y = 1 THEN 'ATTACK' ELSE 'BENIGN' END AS t,
                   CASE WHEN pred = 1 THEN 'ATTACK' ELSE 'BENIGN' END AS p FROM scored),
  conf AS (SELECT t, p, count(*) AS n FROM named GROUP BY 1, 2),
  per AS (SELECT coalesce(a.cls, b.cls) AS cls, coalesce(a.support, 0) AS support,
                 coalesce(a.tp, 0) AS tp, coalesce(b.predicted, 0) AS predicted
          FROM (SELECT t AS cls, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS tp
                FROM conf GROUP BY 1) a
          FULL OUTER JOIN (SELECT p AS cls, sum(n) AS predicted FROM conf GROUP BY 1) b ON a.cls = b.cls),
  rows AS (SELECT cls AS class, pr AS precision, rc AS recall,
                  CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f1,
                  CAST(support AS BIGINT) AS support, tp
           FROM (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS pr,
                           CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc FROM per) x)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rows
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rows
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM rows
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM rows""")
def q_classification_report(spark, sf):
    s = scored(spark, sf).select(
        F.when(F.col("y") == 1, "ATTACK").otherwise("BENIGN").alias("t"),
        F.when(F.col("pred") == 1, "ATTACK").otherwise("BENIGN").alias("p"))
    return rounded(M.classification_report(s, "t", "p"))


@register("recall_per_class", "M11", _SCORED + """
SELECT label, count(*) AS n,
       round(CASE WHEN label = 'BENIGN' THEN 1 - avg(pred) ELSE avg(pred) END, 6) AS recall
FROM scored GROUP BY 1""")
def q_recall_per_class(spark, sf):
    return rounded(M.recall_per_class(scored(spark, sf)))


@register("benign_fpr", "M12", _SCORED + """
SELECT count(*) AS n_benign, round(avg(pred), 6) AS fpr FROM scored WHERE label = 'BENIGN'""")
def q_benign_fpr(spark, sf):
    return rounded(M.benign_fpr(scored(spark, sf)))


@register("f1_delta", "M13", S.with_(S.FLOWS, """s AS (
  SELECT CASE WHEN label IS NOT DISTINCT FROM 'BENIGN' THEN 0 ELSE 1 END AS y,
         CAST(bytes > 100 AS INTEGER) AS p100, CAST(bytes > 50 AS INTEGER) AS p50 FROM flows)""") + """
, c AS (SELECT 'rule_100' AS run, count_if(y = 1 AND p100 = 1) AS tp, count_if(y = 0 AND p100 = 1) AS fp,
               count_if(y = 1 AND p100 = 0) AS fn FROM s
        UNION ALL
        SELECT 'rule_50', count_if(y = 1 AND p50 = 1), count_if(y = 0 AND p50 = 1), count_if(y = 1 AND p50 = 0) FROM s),
  f AS (SELECT run, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c)
SELECT run, round(f1, 6) AS f1, round(f1 - (SELECT f1 FROM f WHERE run = 'rule_100'), 6) AS delta FROM f""")
def q_f1_delta(spark, sf):
    runs = {"rule_100": scored(spark, sf, 100.0), "rule_50": scored(spark, sf, 50.0)}
    return rounded(M.f1_delta(runs, "rule_100"))


@register("unseen_classes", "J5,M4", _F + """
, named AS (SELECT day, label || CASE WHEN dst_port < 16384 THEN ' on ' || day ELSE '' END AS label FROM flows)
SELECT label, count(*) AS n_rows FROM named
WHERE day IN ('Thursday', 'Friday')
  AND label NOT IN (SELECT label FROM named WHERE day IN ('Monday', 'Tuesday', 'Wednesday'))
GROUP BY 1""")
def q_unseen_classes(spark, sf):
    """Classes of the test days that training never saw: flows to the lower ports carry their
    weekday in the class name here, so each test day has classes of its own."""
    f = events_flows(spark, sf).withColumn("label", F.when(
        F.col("dst_port") < 16384, F.concat_ws(" on ", "label", "day")).otherwise(F.col("label")))
    f = SP.day_split(f)
    train = f.where(F.col("side") == "train").select("label").distinct()
    test = f.where(F.col("side") == "test")
    return (test.join(train, "label", "left_anti")
            .groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")))
