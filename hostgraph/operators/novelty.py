"""Per-flow novelty: is this the first flow of its (src, dst) pair in time?

The first occurrence of every pair is found with a *partially aggregated* ``min`` of the
struct (ts, row_id) — one combined row per pair per task, however hot the pair — and the
flag is the equality test after a join on the pair (AQE splits a skewed pair on the flow
side; the pair side has one row per key).  No window sorts a hot pair's flows in one task.
Ties in time are broken by ``row_id`` (the stable original order).  ``min`` of a struct
runs as a sort-based partial aggregation (struct buffers are not hash-aggregated): exact and
spill-friendly, at the price of a per-task sort instead of a hash table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_contacts(flows: DataFrame, src: str = "src", dst: str = "dst", ts: str = "ts",
                   id_col: str = "row_id") -> DataFrame:
    """One row per (src, dst): ``first`` = min struct(ts, row_id)."""
    return (flows.where(F.col(ts).isNotNull())
            .groupBy(src, dst)
            .agg(F.min(F.struct(F.col(ts).alias("ts"), F.col(id_col).alias("id"))).alias("first")))


def flow_novelty(flows: DataFrame, src: str = "src", dst: str = "dst", ts: str = "ts",
                 id_col: str = "row_id", out: str = "novel_dst_for_src") -> DataFrame:
    """Adds ``out``: true iff no earlier flow (by ts, then row_id) had the same pair.  A missing
    end is an end like any other; a flow without a time is never a first contact."""
    firsts = first_contacts(flows, src, dst, ts, id_col)
    f = firsts.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"), "first")
    j = flows.join(f, F.col(src).eqNullSafe(F.col("_src")) & F.col(dst).eqNullSafe(F.col("_dst")), "left")
    return (j.withColumn(out, F.coalesce(
                (F.col("first.ts") == F.col(ts)) & F.col("first.id").eqNullSafe(F.col(id_col)),
                F.lit(False)))
            .drop("first", "_src", "_dst"))


def flow_novelty_both(flows: DataFrame, **kw) -> DataFrame:
    """Forward and reverse flags.  Swapping the columns keys the same ordered pair, so the
    reverse flag equals the forward one by construction — reused, not recomputed."""
    f = flow_novelty(flows, **kw)
    return f.withColumn("novel_src_for_dst", F.col("novel_dst_for_src"))
