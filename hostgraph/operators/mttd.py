"""Time to detection over a scored timeline."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_internal_ip, seconds_between


def first_detection_time(timeline: DataFrame, flag: str = "flagged", ts: str = "ts",
                         mask: F.Column | None = None, out: str = "first_detection") -> DataFrame:
    """Earliest flagged time (inside ``mask`` when given); NULL when nothing is flagged.
    An aggregate, so input order never matters."""
    cond = F.col(flag) if mask is None else (F.col(flag) & mask)
    return timeline.agg(F.min(F.when(cond, F.col(ts))).alias(out))


def hosts_reached_by(cutoff: F.Column, first_col: str = "first_contact") -> F.Column:
    """Aggregate expression: pivots first contacted at or before ``cutoff`` (0 when the
    cutoff is NULL: nothing can be reached before a detection that never happens)."""
    return F.count_if(F.col(first_col) <= cutoff)


def mttd_table(timeline: DataFrame, ts: str = "ts", src: str = "src", dst: str = "dst",
               flag: str = "flagged") -> DataFrame:
    """One row per compromised host: compromise start, first alert on any flow / on the
    pivot chain, latencies in seconds, pivots already reached at each alert, pivots.

    Pivots (one row per novel internal destination) meet the host's cut-offs through an
    equi-join on the host key; the cut-off side has one row per compromised host."""
    pivot = F.col("is_novel_destination") & is_internal_ip(dst)
    det = timeline.groupBy(src).agg(
        F.min(ts).alias("compromise_start"),
        F.min(F.when(F.col(flag), F.col(ts))).alias("first_alert_any"),
        F.min(F.when(F.col(flag) & pivot, F.col(ts))).alias("first_alert_chain"))
    pivots = timeline.where(pivot).groupBy(src, dst).agg(F.min(ts).alias("first_contact"))
    j = pivots.join(det, src, "right")
    out = j.groupBy(src, "compromise_start", "first_alert_any", "first_alert_chain").agg(
        hosts_reached_by(F.col("first_alert_any")).alias("hosts_reached_any"),
        hosts_reached_by(F.col("first_alert_chain")).alias("hosts_reached_chain"),
        F.count("first_contact").alias("n_pivots"))
    return out.select(
        "compromise_start", "first_alert_any", "first_alert_chain",
        seconds_between(F.col("compromise_start"), F.col("first_alert_any")).alias("latency_any_s"),
        seconds_between(F.col("compromise_start"), F.col("first_alert_chain")).alias("latency_chain_s"),
        seconds_between(F.col("first_alert_any"), F.col("first_alert_chain")).alias("gap_s"),
        "hosts_reached_any", "hosts_reached_chain", "n_pivots")
