"""Data-quality profile of a raw flow table, per source file.

All counts are single aggregations (partial on the map side); nothing is collected.
``data_cols`` are the payload columns (everything but the label and provenance).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from ..functions.columns import EN_DASH_LATIN1


def _missing(df: DataFrame, c: str) -> F.Column:
    dtype = df.schema[c].dataType
    if isinstance(dtype, (DoubleType, FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def blank_mask(df: DataFrame, data_cols: list[str]) -> F.Column:
    """True when every payload column is missing (NULL or NaN)."""
    return reduce(lambda a, b: a & b, [_missing(df, c) for c in data_cols])


def numeric_cols(df: DataFrame, data_cols: list[str]) -> list[str]:
    return [c for c in data_cols if isinstance(df.schema[c].dataType, NumericType)]


def profile_blank_rows(df: DataFrame, data_cols: list[str], file_col: str = "source_file",
                       pos_col: str = "capture_pos") -> DataFrame:
    """Per file: rows, blank rows, their share, first/last position, contiguity."""
    blank = blank_mask(df, data_cols)
    agg = df.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(blank).alias("n_blank"),
        F.min(F.when(blank, F.col(pos_col))).alias("first_blank_pos"),
        F.max(F.when(blank, F.col(pos_col))).alias("last_blank_pos"))
    return agg.select(
        file_col, "n_rows", "n_blank",
        (F.col("n_blank") / F.col("n_rows")).alias("blank_rate"),
        "first_blank_pos", "last_blank_pos",
        F.when(F.col("n_blank") > 0,
               F.col("last_blank_pos") - F.col("first_blank_pos") + 1 == F.col("n_blank"))
         .alias("blank_contiguous"))


def profile_duplicates(df: DataFrame, data_cols: list[str], label_col: str = "label",
                       file_col: str = "source_file") -> DataFrame:
    """Per file: non-blank rows equal to an earlier row (NULLs and NaNs compare equal).

    ``groupBy(file, all columns).count()`` then ``sum(count - 1)`` — two partially
    aggregated shuffles, no pairwise comparison.
    """
    real = df.where(~blank_mask(df, data_cols))
    cols = [file_col, *data_cols, label_col]
    return (real.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(file_col)
            .agg(F.sum("_n").alias("n_real"), F.sum(F.col("_n") - 1).alias("n_duplicates")))


def label_distribution(df: DataFrame, data_cols: list[str] | None, label_col: str = "label",
                       file_col: str = "source_file") -> DataFrame:
    """Counts per (file, label) and per label over all files from one ``cube``
    (grouping_level 0 = per file, 2 = all files merged)."""
    real = df if not data_cols else df.where(~blank_mask(df, data_cols))
    return (real.cube(file_col, label_col)
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grouping_level"))
            .where(F.col("grouping_level").isin(0, 2))
            .select(file_col, label_col, "n", "grouping_level"))


def profile_bad_labels(df: DataFrame, data_cols: list[str], label_col: str = "label",
                       file_col: str = "source_file") -> DataFrame:
    real = df.where(~blank_mask(df, data_cols))
    bad = F.col(label_col).contains(EN_DASH_LATIN1) | F.col(label_col).contains("�")
    return real.where(bad).groupBy(file_col, label_col).agg(F.count(F.lit(1)).alias("n"))


def profile_inf_missing(df: DataFrame, data_cols: list[str], file_col: str = "source_file") -> DataFrame:
    """Per file, over numeric payload cells of non-blank rows: +-Inf cells and missing
    (NULL or NaN) cells."""
    real = df.where(~blank_mask(df, data_cols))
    nums = numeric_cols(df, data_cols)
    inf_cells = [F.when(F.abs(F.col(c)) == F.lit(float("inf")), 1).otherwise(0) for c in nums
                 if isinstance(df.schema[c].dataType, (DoubleType, FloatType))]
    miss_cells = [F.when(_missing(df, c), 1).otherwise(0) for c in nums]
    return real.groupBy(file_col).agg(
        F.sum(reduce(lambda a, b: a + b, inf_cells or [F.lit(0)])).cast("long").alias("n_inf"),
        F.sum(reduce(lambda a, b: a + b, miss_cells or [F.lit(0)])).cast("long").alias("n_missing"))


def profile_totals(df: DataFrame, data_cols: list[str], label_col: str = "label",
                   file_col: str = "source_file", id_col: str = "row_id") -> DataFrame:
    """Overall raw / blank / real / duplicate totals and the duplicate rate.

    One grouping by every column (blank flag included) serves all four numbers, so the
    totals come out of a single aggregation chain with no join.  The row's own number is no
    part of a duplicate's key."""
    blank = blank_mask(df, data_cols)
    groups = (df.withColumn("_blank", blank)
              .groupBy(file_col, "_blank", *[c for c in data_cols if c != id_col], label_col)
              .agg(F.count(F.lit(1)).alias("_n")))
    t = groups.agg(
        F.sum("_n").alias("n_raw"),
        F.coalesce(F.sum(F.when(F.col("_blank"), F.col("_n"))), F.lit(0)).alias("n_blank"),
        F.coalesce(F.sum(F.when(~F.col("_blank"), F.col("_n") - 1)), F.lit(0)).alias("n_duplicates"))
    return t.select(
        "n_raw", "n_blank", (F.col("n_raw") - F.col("n_blank")).alias("n_real"), "n_duplicates",
        (F.col("n_duplicates") / F.greatest(F.col("n_raw") - F.col("n_blank"), F.lit(1)))
        .alias("duplicate_rate"))
