"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet and read it back: later readers start from the files, so
    a lost executor never recomputes past this point.  Returns the frame and its folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``write_table`` made."""
    delete_path(spark, path)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hash of ``key`` (all, if there are fewer).

    The rows are counted first, so that tasks pass on only those below a bound that leaves a few
    more than ``rows`` of them (six standard deviations): what meets at the driver does not grow
    with the number of tasks."""
    share = (rows + 6 * math.sqrt(rows) + 16) / max(1, df.count())
    h = F.xxhash64(key)
    return df.where(F.shiftrightunsigned(h, 11) / float(1 << 53) < share).orderBy(h, key).limit(rows)
