"""Distributed running count over a total order (a prefix scan without a global window).

``row_number`` / running ``sum`` over an un-partitioned window moves every row into one
task.  Here the table is range-partitioned on the order key into ``chunks`` ranges (Spark
samples the bounds), each chunk's total is aggregated (one row per chunk), the exclusive
prefix of those totals gives every chunk's offset (a table of ``chunks`` rows — bounded by
the parameter, not the data), and a window partitioned by chunk adds the offset to the
running count inside the chunk.  Work per task is a 1/chunks share of the rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_count(df: DataFrame, flag: str, order_cols: list[str], out: str,
                  chunks: int | None = None) -> DataFrame:
    """``out`` = number of rows with ``flag`` true at or before this row in
    ``order_cols`` order (the order must be total, e.g. end with a unique id).  A ``flag`` that
    is a number counts as often as it says."""
    # without an explicit count the range exchange is sized by the session and coalesced by
    # AQE (adjacent ranges merge, so chunk ids stay in order).  Written once: the chunk
    # totals and the in-chunk window read the same rows, and each row's chunk id is fixed
    # in the written table (a retry cannot re-assign it)
    ranged = df.repartitionByRange(chunks, *order_cols) if chunks else df.repartitionByRange(*order_cols)
    d = materialize(ranged
                    .withColumn("_chunk", F.spark_partition_id())
                    .withColumn("_f", F.col(flag).cast("long")))
    totals = d.groupBy("_chunk").agg(F.sum("_f").alias("_c"))
    offsets = totals.select(
        "_chunk",
        F.coalesce(F.sum("_c").over(Window.orderBy("_chunk")
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"))
    w = (Window.partitionBy("_chunk").orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, 0))
    # ``offsets`` has one row per chunk (bounded by the shuffle width): a bounded broadcast.
    return (d.join(F.broadcast(offsets), "_chunk")
            .withColumn(out, (F.col("_off") + F.sum("_f").over(w)).cast("long"))
            .drop("_chunk", "_f", "_off"))


def exact_quantiles(long: DataFrame, group: str, value: str, order_tail: list[str],
                    qs: tuple = (0.25, 0.5, 0.75), chunks: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics (the rule of
    ``quantile_cont`` / pandas), per group, without gathering a group in one task.

    Every distinct non-null value is one row with the number of its rows (a partial aggregation, so
    a column of few values shuffles few rows), and gets the ranks it covers in its group from the
    distributed running count over ``(group, value)`` minus the rows of earlier groups (a per-group
    count table); only the two order statistics around each quantile position are kept and
    interpolated.  ``order_tail`` told equal values apart and changes nothing.  Output: ``group, q,
    quantile``."""
    d = (long.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_v"))
         .agg(F.count(F.lit(1)).alias("_rows")))
    counted = running_count(d, "_rows", [group, "_v"], "_c", chunks)
    counts = counted.groupBy(group).agg(F.sum("_rows").alias("_n"))
    offs = counts.select(group, "_n", F.coalesce(F.sum("_n").over(
        Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    ranked = (counted.join(offs.select(group, "_off"), group)      # one row per group: AQE plans by its size
              .withColumn("_last", F.col("_c") - F.col("_off") - 1)         # 0-based ranks
              .withColumn("_first", F.col("_last") - F.col("_rows") + 1))
    want = offs.select(group, "_n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    want = want.select(group, "q", (F.col("q") * (F.col("_n") - 1)).alias("_pos"))
    want = want.select(group, "q", "_pos", F.floor("_pos").cast("long").alias("_lo"),
                       F.ceil("_pos").cast("long").alias("_hi"))
    holds = lambda rank: F.col(rank).between(F.col("_first"), F.col("_last"))
    picked = ranked.select(group, "_first", "_last", "_v").join(want, [group]).where(holds("_lo") | holds("_hi"))
    g = picked.groupBy(group, "q", "_pos", "_lo").agg(
        F.max(F.when(holds("_lo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(holds("_hi"), F.col("_v"))).alias("_vhi"))
    return g.select(group, "q", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo"))
                                 * (F.col("_pos") - F.col("_lo"))).alias("quantile"))
