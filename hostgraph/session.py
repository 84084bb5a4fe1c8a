"""Session construction and the shared scratch / checkpoint folder."""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on.  Shuffle partition count is left to the caller (the
# cluster sizes it to the data); AQE coalesces small partitions and splits skewed joins.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "hostgraph", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the cluster.

    The folder comes from ``spark.checkpoint.dir`` (shared storage on a cluster).  Only
    where it is unset and Spark runs in one process (``local``, as in tests) is a private
    folder created; with several executors, also those of ``local-cluster``, an unset
    folder is an error, because a machine-local folder would not survive their loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="hostgraph-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/hostgraph-scratch/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder on whatever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


__all__ = ["get_spark", "ensure_checkpoint_dir", "scratch_path", "delete_path", "materialize", "scale_conf",
           "compilable_methods"]

HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000     # the JVM compiles no longer method, but interprets it row by row


@contextmanager
def compilable_methods(spark: SparkSession) -> Iterator[None]:
    """For jobs that run inside: a stage whose generated method the JVM would not compile (tens of columns imputed and
    assembled in one projection) runs operator by operator, in methods that it does.  The rows are the same."""
    before = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, min(int(before), COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(HUGE_METHOD, before)


def materialize(df):
    """Write ``df`` once as a reliable checkpoint (the cluster's checkpoint folder) and
    return the re-read frame: later branches of a plan read the written rows instead of
    recomputing the lineage, and a lost executor never recomputes past this point."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024 ** 2,
               executors_cores: int | None = None) -> dict:
    """Settings for a run over ``input_bytes`` of flows: scan splits and the initial shuffle
    width sized so a partition stays near ``target_partition_bytes`` (spill-free in a few
    GB of executor memory); AQE then coalesces small partitions and splits skewed ones.

    Example: 100 TB -> ~400,000 initial shuffle partitions, 256 MB scan splits."""
    parts = max(1, input_bytes // target_partition_bytes)
    if executors_cores:
        parts = max(parts, 3 * executors_cores)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        # broadcasts are chosen from measured sizes; keep the threshold modest on big inputs
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
    }
