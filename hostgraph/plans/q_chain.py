"""Catalog entries: per-flow novelty, chain reconstruction, time to detection, id joins
(SURVEY §2.5-2.6)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import is_internal_ip
from ..operators import chain as CH
from ..operators import mttd as MT
from ..operators import novelty as NV
from ..sources.flows import ATTACK_LABEL, FLAG_BYTES_THRESHOLD, events_flows
from . import sqlparts as S
from .registry import register


def flagged_flows(spark, sf):
    return events_flows(spark, sf).withColumn("flagged", F.col("bytes") > FLAG_BYTES_THRESHOLD)


def timeline(spark, sf):
    f = flagged_flows(spark, sf)
    pz, t0 = CH.anchor_values(CH.compromise_window(f, ATTACK_LABEL))
    return CH.post_compromise_timeline(f, pz, t0), t0


_TL = S.with_(S.FLOWS, f"""anchor AS (
  SELECT CASE WHEN count(DISTINCT src) = 1 THEN min(src) END AS patient_zero,
         min(ts) AS compromise_start, max(ts) AS compromise_end, count(*) AS n_flows,
         count(DISTINCT dst) AS n_destinations
  FROM flows WHERE label = '{ATTACK_LABEL}')""", """host AS (
  SELECT f.*, f.bytes > 100 AS flagged, a.compromise_start AS t0,
         row_number() OVER (PARTITION BY f.dst ORDER BY f.ts, f.row_id) = 1 AS is_first
  FROM flows f JOIN anchor a ON f.src = a.patient_zero WHERE f.ts IS NOT NULL)""", """prior AS (
  SELECT count(DISTINCT dst) AS n_prior_destinations FROM host WHERE ts < t0)""", """tl AS (
  SELECT h.row_id, h.src, h.dst, h.ts, h.dst_port, h.flagged, is_first AS is_novel_destination,
         p.n_prior_destinations,
         p.n_prior_destinations + sum(CAST(is_first AS INTEGER)) OVER (ORDER BY h.ts, h.row_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_distinct_destinations
  FROM host h, prior p WHERE h.ts >= h.t0)""")

_TL_COLS = ("row_id", "dst", "ts", "flagged", "is_novel_destination",
            "cumulative_distinct_destinations", "n_prior_destinations")


@register("flow_novelty", "G1", S.with_(S.FLOWS) + """
SELECT row_id, row_number() OVER (PARTITION BY src, dst ORDER BY ts, row_id) = 1 AS novel_dst_for_src
FROM flows""")
def q_flow_novelty(spark, sf):
    return NV.flow_novelty(events_flows(spark, sf)).select("row_id", "novel_dst_for_src")


@register("flow_novelty_rev", "G2", S.with_(S.FLOWS) + """
SELECT row_id, row_number() OVER (PARTITION BY dst, src ORDER BY ts, row_id) = 1 AS novel_src_for_dst
FROM flows""")
def q_flow_novelty_rev(spark, sf):
    return NV.flow_novelty_both(events_flows(spark, sf)).select("row_id", "novel_src_for_dst")


@register("novelty_join", "J3", S.with_(S.FLOWS) + """
SELECT f.row_id, f.label, n.novel AS novel_dst_for_src
FROM flows f LEFT JOIN (SELECT row_id, row_number() OVER (PARTITION BY src, dst ORDER BY ts, row_id) = 1 AS novel
                        FROM flows) n USING (row_id)""")
def q_novelty_join(spark, sf):
    f = events_flows(spark, sf)
    flags = NV.flow_novelty(f).select("row_id", "novel_dst_for_src")
    j = f.select("row_id", "label").join(flags, "row_id", "left")
    # an unmatched row is an error, not a silent NULL
    return j.withColumn("novel_dst_for_src", F.when(F.col("novel_dst_for_src").isNull(),
                        F.raise_error(F.lit("unmatched row after novelty join")).cast("boolean"))
                        .otherwise(F.col("novel_dst_for_src")))


@register("patient_zero", "G3", _TL + "SELECT patient_zero FROM anchor")
def q_patient_zero(spark, sf):
    return CH.compromise_window(events_flows(spark, sf), ATTACK_LABEL).select("patient_zero")


@register("compromise_window", "G4", _TL + """
SELECT patient_zero, compromise_start, compromise_end, n_flows, n_destinations FROM anchor""")
def q_compromise_window(spark, sf):
    return CH.compromise_window(events_flows(spark, sf), ATTACK_LABEL)


@register("chain_timeline", "G5", _TL + "SELECT " + ", ".join(_TL_COLS) + " FROM tl")
def q_chain_timeline(spark, sf):
    tl, _ = timeline(spark, sf)
    return tl.select(*_TL_COLS)


@register("pivot_summary", "G6", _TL + """
SELECT dst, min(ts) AS first_contact, arg_min(dst_port, (ts, row_id)) AS destination_port,
       count(*) AS n_flows, bool_or(flagged) AS model_flagged_any
FROM tl WHERE is_novel_destination AND starts_with(dst, '192.168.') GROUP BY 1""")
def q_pivot_summary(spark, sf):
    tl, _ = timeline(spark, sf)
    return CH.pivot_summary(tl)


@register("novel_summary", "G7", _TL + """
SELECT dst, min(ts) AS first_contact, count(*) AS n_flows, starts_with(dst, '192.168.') AS is_internal,
       bool_or(flagged) AS model_flagged_any
FROM tl WHERE is_novel_destination GROUP BY 1""")
def q_novel_summary(spark, sf):
    tl, _ = timeline(spark, sf)
    return CH.novel_summary(tl)


@register("chain_headline", "G8", _TL + """
SELECT count(*) AS n_flows, count(DISTINCT dst) AS n_destinations,
       count_if(is_novel_destination) AS n_novel_flows, count_if(flagged) AS n_flagged,
       min(CASE WHEN is_novel_destination THEN ts END) AS first_novel_contact,
       count_if(is_novel_destination AND starts_with(dst, '192.168.')) AS n_pivots,
       count_if(is_novel_destination AND starts_with(dst, '192.168.') AND flagged) AS n_pivots_caught,
       max(n_prior_destinations) AS n_prior_destinations,
       round(count_if(flagged) / count(*), 6) AS flagged_share,
       round((epoch_us(min(CASE WHEN is_novel_destination THEN ts END))
              - epoch_us((SELECT compromise_start FROM anchor))) / 1e6, 6) AS first_novel_latency_s
FROM tl""")
def q_chain_headline(spark, sf):
    from .registry import rounded
    tl, t0 = timeline(spark, sf)
    return rounded(CH.chain_headline(tl, t0))


@register("pivot_semi_join", "G9,J4", _TL + """
SELECT f.row_id, f.dst, f.ts FROM flows f
WHERE f.row_id IN (SELECT row_id FROM tl WHERE is_novel_destination AND starts_with(dst, '192.168.'))""")
def q_pivot_semi_join(spark, sf):
    tl, _ = timeline(spark, sf)
    ids = tl.where(F.col("is_novel_destination") & is_internal_ip("dst")).select("row_id")
    return events_flows(spark, sf).join(ids, "row_id", "left_semi").select("row_id", "dst", "ts")


@register("first_detection", "T1", _TL + """
SELECT min(CASE WHEN flagged THEN ts END) AS first_detection,
       min(CASE WHEN flagged AND is_novel_destination AND starts_with(dst, '192.168.') THEN ts END)
         AS first_detection_chain FROM tl""")
def q_first_detection(spark, sf):
    tl, _ = timeline(spark, sf)
    pivot = F.col("is_novel_destination") & is_internal_ip("dst")
    return tl.agg(F.min(F.when(F.col("flagged"), F.col("ts"))).alias("first_detection"),
                  F.min(F.when(F.col("flagged") & pivot, F.col("ts"))).alias("first_detection_chain"))


_MTTD_SQL = _TL + """
, piv AS (SELECT dst, min(ts) AS first_contact FROM tl
          WHERE is_novel_destination AND starts_with(dst, '192.168.') GROUP BY 1),
  det AS (SELECT min(ts) AS compromise_start, min(CASE WHEN flagged THEN ts END) AS first_alert_any,
                 min(CASE WHEN flagged AND is_novel_destination AND starts_with(dst, '192.168.') THEN ts END)
                   AS first_alert_chain FROM tl)
SELECT compromise_start, first_alert_any, first_alert_chain,
       round((epoch_us(first_alert_any) - epoch_us(compromise_start)) / 1e6, 6) AS latency_any_s,
       round((epoch_us(first_alert_chain) - epoch_us(compromise_start)) / 1e6, 6) AS latency_chain_s,
       round((epoch_us(first_alert_chain) - epoch_us(first_alert_any)) / 1e6, 6) AS gap_s,
       (SELECT count_if(first_contact <= det.first_alert_any) FROM piv) AS hosts_reached_any,
       (SELECT count_if(first_contact <= det.first_alert_chain) FROM piv) AS hosts_reached_chain,
       (SELECT count(*) FROM piv) AS n_pivots
FROM det"""


@register("hosts_reached", "T2", _MTTD_SQL.split("SELECT compromise_start, first_alert_any,")[0] + """
SELECT 'any' AS cutoff_name, first_alert_any AS cutoff,
       (SELECT count_if(first_contact <= det.first_alert_any) FROM piv) AS hosts_reached FROM det
UNION ALL
SELECT 'chain', first_alert_chain,
       (SELECT count_if(first_contact <= det.first_alert_chain) FROM piv) FROM det""")
def q_hosts_reached(spark, sf):
    tl, _ = timeline(spark, sf)
    m = MT.mttd_table(tl)
    return m.select(F.explode(F.array(
        F.struct(F.lit("any").alias("cutoff_name"), F.col("first_alert_any").alias("cutoff"),
                 F.col("hosts_reached_any").alias("hosts_reached")),
        F.struct(F.lit("chain").alias("cutoff_name"), F.col("first_alert_chain").alias("cutoff"),
                 F.col("hosts_reached_chain").alias("hosts_reached")))).alias("r")).select("r.*")


@register("mttd", "T3", _MTTD_SQL)
def q_mttd(spark, sf):
    from .registry import rounded
    tl, _ = timeline(spark, sf)
    return rounded(MT.mttd_table(tl))


@register("novelty_true_rate", "B12", S.with_(S.FLOWS) + """
SELECT label, count(*) AS n, round(avg(CAST(nv AS INTEGER)), 6) AS novel_rate
FROM (SELECT label, row_number() OVER (PARTITION BY src, dst ORDER BY ts, row_id) = 1 AS nv FROM flows) x
GROUP BY 1""")
def q_novelty_true_rate(spark, sf):
    """Share of flows that are a first contact, per label (mean of a boolean)."""
    from .registry import rounded
    f = NV.flow_novelty(events_flows(spark, sf))
    return rounded(f.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                          F.avg(F.col("novel_dst_for_src").cast("double")).alias("novel_rate")))
