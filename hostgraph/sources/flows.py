"""The canonical flow view.

Every operator works on a generic flow table

    row_id long, src string, dst string, ts timestamp_ntz, bytes double,
    label string, day string, dst_port int

and takes column names as parameters where it matters.  Two views are derived from the
driver's tables:

* ``events_flows``   — users talk to ``props.k`` targets; both ids share one id space, so
  triangles, mutual edges, sinks and self-loops all occur.  ``view`` events are BENIGN,
  ``error`` events of user 8 are the ``Infiltration`` label (one source -> patient zero).
* ``lineitem_flows`` — supplier -> part edges over seven years, the larger bench input.

``raw_flows`` adds the defects the cleaning operators exist for (blank rows, partial
nulls, +-Inf, NaN, a mis-encoded en-dash, stray blanks) by fixed row rules, and a source
file name per weekday, so profiling and cleaning have something to find.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import BENIGN, EN_DASH_LATIN1, host_name
from .tables import read_table

FLOW_COLUMNS = ("row_id", "src", "dst", "ts", "bytes", "label", "day", "dst_port")

# Fixed values of the synthetic mapping.
ATTACK_LABEL = "Infiltration"
PATIENT_ZERO_ID = 8
COPY_OFFSET = 1_000_000_000_000   # capture position of a repeated row, beyond all others
FLAG_BYTES_THRESHOLD = 100.0      # stand-in detector: a flow is flagged when bytes > 100


def events_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    label = (F.when(F.col("event_type") == "view", F.lit(BENIGN))
             .when((F.col("event_type") == "error") & (F.col("user_id") == PATIENT_ZERO_ID),
                   F.lit(ATTACK_LABEL))
             .otherwise(F.col("event_type")))
    return ev.select(
        F.col("event_id").alias("row_id"),
        host_name(F.col("user_id")).alias("src"),
        host_name(k).alias("dst"),
        F.col("ts"),
        F.col("value").alias("bytes"),
        label.alias("label"),
        F.date_format("ts", "EEEE").alias("day"),
        F.pmod(F.col("event_id") * 7919, F.lit(65536)).cast("int").alias("dst_port"),
    )


def lineitem_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> part shipments as flows.  ``(l_orderkey, l_linenumber)`` is not unique
    in the driver's data, so ``row_id`` is only a tie-breaker here, not an identity."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("bytes"),
        F.when(F.col("l_returnflag") == "N", F.lit(BENIGN))
         .otherwise(F.concat(F.lit("return-"), F.col("l_returnflag"))).alias("label"),
        F.date_format("l_shipdate", "EEEE").alias("day"),
        F.col("l_linenumber").alias("dst_port"),
    )


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events flows with injected defects, as a raw capture would look.

    Rules (all on ``row_id``; they tag rows, they never drop any):
      * ``% 97 == 0``  blank row: every column but the label is NULL
      * ``% 7 == 0``   bytes NULL (partial null, must survive cleaning)
      * ``% 11 == 0``  bytes +Inf, ``% 13 == 0`` bytes -Inf, ``% 17 == 0`` bytes NaN
      * ``% 5 == 0``   non-benign labels written as ``Web Attack <en-dash> <label>``
        padded with blanks
      * ``% 89 == 5``  the row occurs twice (``capture_pos`` tells the copies apart)
    ``source_file`` is the capture file the row came from: one a weekday, but two on Thursday
    and three on Friday, by the time of day (and ``row_id`` on Friday afternoon).
    """
    copies = F.when(F.col("row_id") % 89 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    f = events_flows(spark, sf_dir).withColumn("copy", F.explode(copies))
    rid = F.col("row_id")
    morning = F.hour("ts") < 12
    part = (F.when((F.col("day") == "Thursday") & morning, F.lit("-WorkingHours-Morning-WebAttacks"))
            .when(F.col("day") == "Thursday", F.lit("-WorkingHours-Afternoon-Infilteration"))
            .when((F.col("day") == "Friday") & morning, F.lit("-WorkingHours-Morning"))
            .when((F.col("day") == "Friday") & (rid % 2 == 0), F.lit("-WorkingHours-Afternoon-DDos"))
            .when(F.col("day") == "Friday", F.lit("-WorkingHours-Afternoon-PortScan"))
            .when(F.col("day") == "Wednesday", F.lit("-workingHours"))
            .otherwise(F.lit("-WorkingHours")))
    blank = (rid % 97) == 0
    bytes_ = (F.when(rid % 7 == 0, F.lit(None).cast("double"))
              .when(rid % 11 == 0, F.lit(float("inf")))
              .when(rid % 13 == 0, F.lit(float("-inf")))
              .when(rid % 17 == 0, F.lit(float("nan")))
              .otherwise(F.col("bytes")))
    label = (F.when((rid % 5 == 0) & (F.col("label") != BENIGN),
                    F.concat(F.lit("  Web Attack " + EN_DASH_LATIN1 + " "), F.col("label"), F.lit(" ")))
             .otherwise(F.col("label")))

    def keep(c):
        return F.when(blank, F.lit(None)).otherwise(c)

    return f.select(
        keep(F.col("row_id")).alias("row_id"),
        keep(F.col("src")).alias("src"),
        keep(F.col("dst")).alias("dst"),
        keep(F.col("ts")).alias("ts"),
        keep(bytes_).alias("bytes"),
        label.alias("label"),
        keep(F.col("dst_port")).alias("dst_port"),
        F.concat(F.col("day"), part, F.lit(".pcap_ISCX.csv")).alias("source_file"),
        (F.col("row_id") + F.col("copy") * F.lit(COPY_OFFSET)).alias("capture_pos"),
    )
