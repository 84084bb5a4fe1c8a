"""Sinks: partitioned parquet tables and small report tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: tuple = ("day",)) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json", order_by: tuple = ()) -> None:
    """A report table: already small by construction (an aggregate); one file."""
    if order_by:
        df = df.orderBy(*order_by)
    df.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(path)
