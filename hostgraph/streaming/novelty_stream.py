"""Streaming per-flow novelty: emit a flow iff its (src, dst) pair was never seen before.

Keyed state on the RocksDB store: one value per pair, looked up only for the pairs of a micro-batch, so a
batch costs its own rows whatever came before; nothing that was emitted is read again.  The file sink and
the state share one checkpoint, so a batch that runs again neither repeats nor loses a flow.

Inside one micro-batch the earliest row by (ts, row_id) is emitted; across batches the answer
follows arrival order: a late row that is earlier in event time than an emitted first contact
cannot retract it (the batch operator, which sees all rows, is the reference for ordered input).
With ``forget_after`` a timer per pair drops its state once the watermark is that far past its last
flow, so the state is bounded by the pairs of that span; the pair's next flow counts as new again, and
rows behind the watermark are late: they are dropped by the watermark's rule.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# times cross to Python as whole microseconds: no datetime is built per row
SCHEMA = "row_id long, src string, dst string, us long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstContact(StatefulProcessor):
    """State of a pair: the time (ms) of its latest flow; ``forget_ms`` None: kept for ever.  Most pairs have few
    rows in a batch, so rows are taken one by one: a frame per pair would cost more than the rows."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, first, latest = None, None, None
        for row in rows:
            us, row_id = row["us"], row["row_id"]
            latest = us if latest is None else max(latest, us)
            place = (us, row_id is None, row_id or 0)
            if best is None or place < best:
                best, first = place, row
        if first is None:
            return
        ms = latest // 1000
        known = self.latest.get()
        if known is None or (self.forget_ms is not None and ms > known[0]):
            self.latest.update((ms,))
            if self.forget_ms is not None:
                if known is not None:
                    self.handle.deleteTimer(known[0] + self.forget_ms)
                self.handle.registerTimer(ms + self.forget_ms)
        if known is None:
            yield Row(row_id=first["row_id"], src=first["src"], dst=first["dst"], us=first["us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.latest.clear()
        return iter([])

    def close(self) -> None:
        pass


def novel_flows(flows: DataFrame, forget_after: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The stream of first contacts.  NULL ends are keys like any other; rows without a time are left out."""
    rows = flows.select("row_id", "src", "dst", "ts").where(F.col("ts").isNotNull()).withColumn("us", F.unix_micros("ts"))
    if forget_after is None:
        out = rows.drop("ts").groupBy("src", "dst").transformWithState(FirstContact(), SCHEMA, "Append", "None")
    else:
        ms = int(pd.Timedelta(forget_after) / pd.Timedelta("1ms"))
        out = (rows.withWatermark("ts", delay).groupBy("src", "dst")
               .transformWithState(FirstContact(ms), SCHEMA, "Append", "EventTime"))
    return out.select("row_id", "src", "dst", F.timestamp_micros("us").alias("ts"))


def drain_novel_flows(flows: DataFrame, path: str, checkpoint: str, forget_after: str | None = None,
                      delay: str = "10 minutes") -> None:
    """Drain what a feed has now into the table at ``path``; a later call goes on from the checkpoint."""
    conf = flows.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        (novel_flows(flows, forget_after, delay).writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        conf.set(PROVIDER, before)
