"""Streaming edge table: tumbling event-time windows per (src, dst) with a watermark.

Append mode emits a window once the watermark (max event time seen minus the allowed
delay) passes its end; rows arriving later than that are dropped, and the state of a
closed window is evicted, so state stays bounded by the open windows.  A finished feed never
passes the end of its last windows; ``windowed_edges_complete`` therefore keeps a table of
partial sums that every micro-batch adds to, from which all windows can be read at any time.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(flows: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return (flows.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
            .withWatermark("ts", delay)
            .groupBy(F.window("ts", width).alias("w"), "src", "dst")
            .agg(F.count(F.lit(1)).alias("flow_count"),
                 F.coalesce(F.sum("bytes"), F.lit(0.0)).alias("total_bytes"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "src", "dst",
                    "flow_count", "total_bytes"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain everything available now into a parquet table (exactly-once file sink with
    its own checkpoint), then stop."""
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def drain_partial_edges(flows: DataFrame, path: str, checkpoint: str, width: str = "1 hour") -> None:
    """Drain a feed into a table of partial edges: each micro-batch appends its own partially
    aggregated (window, src, dst) rows under its number, so a batch that runs again replaces
    what it wrote.  Late rows count like any other and no window stays open."""
    def add(batch: DataFrame, number: int) -> None:
        (batch.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("ts").isNotNull())
         .groupBy(F.window("ts", width).alias("w"), "src", "dst")
         .agg(F.count(F.lit(1)).alias("flow_count"), F.sum("bytes").alias("total_bytes"))
         .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "src", "dst", "flow_count", "total_bytes")
         .write.mode("overwrite").parquet(f"{path}/batch={number}"))

    (flows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def windowed_edges_complete(partial: DataFrame) -> DataFrame:
    """All windows, closed or open, from the partial edges."""
    return partial.groupBy("bucket", "src", "dst").agg(
        F.sum("flow_count").alias("flow_count"), F.coalesce(F.sum("total_bytes"), F.lit(0.0)).alias("total_bytes"))
