"""Flow table -> weighted directed edge table, one graph per time bucket (all buckets at once).

Edge table: ``bucket, src, dst, flow_count long, total_bytes double`` — one row per ordered
host pair and bucket.  This replaces a dictionary of in-memory graph objects: every graph
operator below is a grouping or join on this table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket_floor


def with_bucket(flows: DataFrame, width: str = "1 hour", ts: str = "ts",
                out: str = "bucket") -> DataFrame:
    return flows.withColumn(out, bucket_floor(ts, width))


def build_edges(flows: DataFrame, width: str = "1 hour", src: str = "src", dst: str = "dst",
                ts: str = "ts", bytes_col: str = "bytes", carry: dict | None = None) -> DataFrame:
    """Per bucket and ordered (src, dst): number of flows and summed bytes.

    Rows with a NULL key are dropped (grouping semantics of the analysed pipeline); NULL
    bytes are skipped and an all-NULL sum is 0.0.  ``groupBy`` aggregates partially on the
    map side, so a host sending a third of all flows costs one combined row per task.
    ``carry`` adds further aggregates of the same pass (name -> aggregate column).
    """
    extra = [agg.alias(name) for name, agg in (carry or {}).items()]
    return (flows
            .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(ts).isNotNull())
            .withColumn("bucket", bucket_floor(ts, width))
            .withColumnRenamed(bytes_col, "_b")
            .withColumnRenamed(src, "src").withColumnRenamed(dst, "dst")
            .groupBy("bucket", "src", "dst")
            .agg(F.count(F.lit(1)).alias("flow_count"),
                 F.coalesce(F.sum("_b"), F.lit(0.0)).alias("total_bytes"), *extra))


def node_table(edges: DataFrame) -> DataFrame:
    """Hosts on either end of an edge, per bucket."""
    return (edges.select("bucket", F.explode(F.array("src", "dst")).alias("host"))
            .distinct())


def graph_summary(edges: DataFrame, day_col: str | None = None) -> DataFrame:
    """Per bucket: edges, total flows, nodes (and the bucket's first day name when the
    edge table carries ``day_col``, e.g. ``build_edges(..., carry={"day": F.min("day")})``).
    Callers that reuse ``edges`` should materialise it first."""
    aggs = [F.count(F.lit(1)).alias("n_edges"), F.sum("flow_count").alias("total_flows")]
    if day_col:
        aggs.append(F.min(day_col).alias("day"))
    per_edge = edges.groupBy("bucket").agg(*aggs)
    per_node = node_table(edges).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_nodes"))
    return per_edge.join(per_node, "bucket")
