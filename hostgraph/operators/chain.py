"""Post-compromise chain reconstruction.

The analysed pipeline loops over one host's flows with a Python set.  Here:

* the first flow to every destination is a partially aggregated ``min(struct(ts, id))``
  over the host's *whole* history (one row per destination);
* a flow is novel iff it is that first flow and it happens at or after t0 — the prior set
  is everything first contacted before t0;
* the running number of distinct destinations is ``n_prior`` plus a distributed running
  count of novel flows (``operators.scan``), never a window over the whole timeline.

Patient zero and t0 are two driver scalars from one small aggregate job (the label's
rows); used as literals they become filters right after the scan instead of repeated
one-row joins.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_internal_ip, lit_as, seconds_between
from .scan import running_count


def compromise_window(flows: DataFrame, attack_label: str, label_col: str = "label",
                      src: str = "src", dst: str = "dst", ts: str = "ts") -> DataFrame:
    """One row: patient zero (the label's single source), first/last time, flows,
    distinct destinations.  ``n_sources`` != 1 makes ``patient_zero`` raise on use."""
    a = flows.where(F.col(label_col) == attack_label)
    agg = a.agg(F.count_distinct(src).alias("n_sources"), F.min(src).alias("_pz"),
                F.min(ts).alias("compromise_start"), F.max(ts).alias("compromise_end"),
                F.count(F.lit(1)).alias("n_flows"), F.count_distinct(dst).alias("n_destinations"))
    pz = F.when(F.col("n_sources") == 1, F.col("_pz")).otherwise(F.raise_error(F.concat(
        F.lit(f"label {attack_label!r} must come from a single source; sources found: "),
        F.col("n_sources").cast("string"))))
    return agg.select(pz.alias("patient_zero"), "compromise_start", "compromise_end",
                      "n_flows", "n_destinations")


def find_patient_zero(flows: DataFrame, attack_label: str, label_col: str = "label",
                      src: str = "src") -> str:
    """Driver-side scalar (two distinct values at most are fetched)."""
    srcs = [r[0] for r in flows.where(F.col(label_col) == attack_label)
            .select(src).distinct().limit(2).collect()]
    if len(srcs) != 1:
        raise ValueError(f"label {attack_label!r} must come from a single source; found {srcs}")
    return srcs[0]


def anchor_values(anchor: DataFrame) -> tuple:
    """(patient_zero, compromise_start) as driver scalars: one row of two values."""
    row = anchor.select("patient_zero", "compromise_start").first()
    return row["patient_zero"], row["compromise_start"]


def post_compromise_timeline(flows: DataFrame, patient_zero: str, t0, src: str = "src",
                             dst: str = "dst", ts: str = "ts", id_col: str = "row_id",
                             chunks: int | None = None) -> DataFrame:
    """Flows of ``patient_zero`` at or after ``t0``, with ``is_novel_destination``,
    ``cumulative_distinct_destinations`` and ``n_prior_destinations``.  A missing destination
    counts as one destination of its own; flows without a time have no place in the order and
    are left out.  Host and time are literals, so the host filter is evaluated right after the scan."""
    host = flows.where((F.col(src) == F.lit(patient_zero)) & F.col(ts).isNotNull())
    t0c = lit_as(t0, flows.schema[ts].dataType)
    firsts = (host.groupBy(src, dst)
              .agg(F.min(F.struct(F.col(ts).alias("ts"), F.col(id_col).alias("id"))).alias("_first")))
    # one row per host: joined back on the host key
    n_prior = (firsts.groupBy(src)
               .agg(F.count_if(F.col("_first.ts") < t0c).alias("n_prior_destinations")))
    tl = (host.where(F.col(ts) >= t0c)
          .join(firsts.select(F.col(dst).alias("_dst"), "_first"), F.col(dst).eqNullSafe(F.col("_dst")))
          .withColumn("is_novel_destination",
                      (F.col("_first.ts") == F.col(ts)) & F.col("_first.id").eqNullSafe(F.col(id_col)))
          .drop("_first", "_dst"))
    tl = running_count(tl, "is_novel_destination", [ts, id_col], "_novel_so_far", chunks)
    return (tl.join(F.broadcast(n_prior), src)
            .withColumn("cumulative_distinct_destinations",
                        F.col("n_prior_destinations") + F.col("_novel_so_far"))
            .drop("_novel_so_far"))


def pivot_summary(timeline: DataFrame, dst: str = "dst", ts: str = "ts", id_col: str = "row_id",
                  port: str = "dst_port", flag: str = "flagged", internal_only: bool = True) -> DataFrame:
    """Novel destinations (internal ones by default): first contact, port of the first
    flow, flows, whether any flow to it was flagged."""
    t = timeline.where(F.col("is_novel_destination"))
    if internal_only:
        t = t.where(is_internal_ip(dst))
    return t.groupBy(dst).agg(
        F.min(ts).alias("first_contact"),
        F.min_by(port, F.struct(ts, id_col)).alias("destination_port"),
        F.count(F.lit(1)).alias("n_flows"),
        F.bool_or(flag).alias("model_flagged_any"))


def novel_summary(timeline: DataFrame, dst: str = "dst", ts: str = "ts",
                  flag: str = "flagged") -> DataFrame:
    t = timeline.where(F.col("is_novel_destination"))
    return t.groupBy(dst).agg(
        F.min(ts).alias("first_contact"), F.count(F.lit(1)).alias("n_flows"),
        F.first(is_internal_ip(dst)).alias("is_internal"),
        F.bool_or(flag).alias("model_flagged_any"))


def chain_headline(timeline: DataFrame, t0, dst: str = "dst", ts: str = "ts",
                   flag: str = "flagged") -> DataFrame:
    """One row of chain counts: a single global aggregate (partial per task)."""
    novel = F.col("is_novel_destination")
    pivot = novel & is_internal_ip(dst)
    t0c = lit_as(t0, timeline.schema[ts].dataType)
    first_novel = F.min(F.when(novel, F.col(ts)))
    return timeline.agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.count_distinct(dst).alias("n_destinations"),
        F.count_if(novel).alias("n_novel_flows"),
        F.count_if(F.col(flag)).alias("n_flagged"),
        first_novel.alias("first_novel_contact"),
        F.count_if(pivot).alias("n_pivots"),
        F.count_if(pivot & F.col(flag)).alias("n_pivots_caught"),
        F.max("n_prior_destinations").alias("n_prior_destinations"),
        (F.count_if(F.col(flag)) / F.count(F.lit(1))).alias("flagged_share"),
        seconds_between(t0c, first_novel).alias("first_novel_latency_s"))
