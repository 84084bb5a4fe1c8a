"""Catalog entries: scans, sinks, profiling, cleaning, scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean as CL
from ..operators import profile as PR
from ..session import scratch_path
from ..sources import csv_source as CSV
from ..sources import sinks
from ..sources.flows import events_flows, raw_flows
from . import sqlparts as S
from .registry import register, rounded

RAW_DATA_COLS = ["row_id", "src", "dst", "ts", "bytes", "dst_port"]
_RAW = S.with_(S.FLOWS, S.RAW_FLOWS)
_BLANK_SQL = ("(row_id IS NULL AND src IS NULL AND dst IS NULL AND ts IS NULL "
              "AND (bytes IS NULL OR isnan(bytes)) AND dst_port IS NULL)")
_RAW_COLS = ("row_id, src, dst, ts, bytes, label, dst_port, source_file, capture_pos")


def _capture(spark, sf):
    raw = raw_flows(spark, sf)
    path = scratch_path(spark, "capture")
    CSV.write_capture(raw, path)
    return raw, path


@register("scan_csv", "A1,A4,B1", _RAW + f"SELECT {_RAW_COLS} FROM raw")
def q_scan_csv(spark, sf):
    raw, path = _capture(spark, sf)
    df = CSV.scan_capture(spark, path, CSV.capture_schema(raw))
    return df.select(*_RAW_COLS.split(", "))


@register("union_sources", "A5", _RAW + "SELECT source_file, count(*) AS n_rows FROM raw GROUP BY 1")
def q_union_sources(spark, sf):
    raw, path = _capture(spark, sf)
    schema = CSV.capture_schema(raw)
    files = sorted(r[0] for r in raw.select("source_file").distinct().collect())   # ten at most
    frames = [CSV.scan_capture(spark, f"{path}/{f}", schema) for f in files]
    return CSV.union_sources(frames).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))


@register("tag_source_day", "A6", _RAW + f"""
SELECT capture_pos, source_file, regexp_extract(source_file, '^[A-Z][a-z]+') AS day
FROM raw WHERE NOT {_BLANK_SQL}""")
def q_tag_source_day(spark, sf):
    raw = CL.drop_blank_rows(raw_flows(spark, sf))
    return CL.tag_source_day(raw).select("capture_pos", "source_file", "day")


@register("clean_capture", "A1,A6,P1,P2,P3", _RAW + f"""
SELECT capture_pos, row_id, src, dst, ts, source_file, regexp_extract(source_file, '^[A-Z][a-z]+') AS day,
       regexp_replace(replace(label, chr(150), '-'), '^\\s+|\\s+$', '', 'g') AS label,
       CASE WHEN isnan(bytes) OR abs(bytes) = 'Infinity'::DOUBLE THEN NULL ELSE round(bytes, 6) END AS bytes
FROM raw WHERE NOT {_BLANK_SQL}""")
def q_clean_capture(spark, sf):
    """The whole preparation: flat capture folder -> weekday from the file's name -> clean rows."""
    raw, path = _capture(spark, sf)
    df = CL.clean_flows(CSV.scan_capture(spark, path, CSV.capture_schema(raw)))
    return rounded(df.select("capture_pos", "row_id", "src", "dst", "ts", "source_file", "day", "label", "bytes"))


_FLOWS_BACK = S.with_(S.FLOWS) + "SELECT row_id, src, dst, ts, round(bytes, 6) AS bytes, label, dst_port, day FROM flows"


def _flows_by_day(spark, sf):
    path = scratch_path(spark, "flows-by-day")
    sinks.write_parquet(events_flows(spark, sf), path, ("day",))
    return sinks.read_parquet(spark, path).select("row_id", "src", "dst", "ts", "bytes", "label", "dst_port", "day")


@register("roundtrip_parquet", "A7", _FLOWS_BACK)
def q_roundtrip_parquet(spark, sf):
    """All flows, written by weekday and read back."""
    return rounded(_flows_by_day(spark, sf))


@register("pruned_days", "A7,P11", _FLOWS_BACK + " WHERE day IN ('Thursday', 'Friday')")
def q_pruned_days(spark, sf):
    """The same table asked for two days: only their folders are listed and scanned."""
    return rounded(_flows_by_day(spark, sf).where(F.col("day").isin("Thursday", "Friday")))


@register("profile_blank_rows", "B2", _RAW + f"""
SELECT source_file, count(*) AS n_rows, count_if({_BLANK_SQL}) AS n_blank,
       round(count_if({_BLANK_SQL}) / count(*), 6) AS blank_rate,
       min(CASE WHEN {_BLANK_SQL} THEN capture_pos END) AS first_blank_pos,
       max(CASE WHEN {_BLANK_SQL} THEN capture_pos END) AS last_blank_pos,
       CASE WHEN count_if({_BLANK_SQL}) > 0 THEN
         max(CASE WHEN {_BLANK_SQL} THEN capture_pos END)
         - min(CASE WHEN {_BLANK_SQL} THEN capture_pos END) + 1 = count_if({_BLANK_SQL}) END
         AS blank_contiguous
FROM raw GROUP BY 1""")
def q_profile_blank_rows(spark, sf):
    return rounded(PR.profile_blank_rows(raw_flows(spark, sf), RAW_DATA_COLS))


_DUP_COLS = "src, dst, ts, bytes, dst_port, label"


@register("profile_duplicates", "B3", _RAW + f"""
SELECT source_file, CAST(sum(n) AS BIGINT) AS n_real, CAST(sum(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT source_file, {_DUP_COLS}, count(*) AS n FROM raw WHERE NOT {_BLANK_SQL}
      GROUP BY ALL) g GROUP BY 1""")
def q_profile_duplicates(spark, sf):
    raw = raw_flows(spark, sf)
    real = raw.where(~PR.blank_mask(raw, RAW_DATA_COLS))
    return PR.profile_duplicates(real.drop("row_id"), ["src", "dst", "ts", "bytes", "dst_port"])


@register("label_distribution", "B4,B9", _RAW + f"""
SELECT source_file, label, count(*) AS n,
       CAST(grouping(source_file) * 2 + grouping(label) AS INTEGER) AS grouping_level
FROM raw WHERE NOT {_BLANK_SQL}
GROUP BY GROUPING SETS ((source_file, label), (label))""")
def q_label_distribution(spark, sf):
    return PR.label_distribution(raw_flows(spark, sf), RAW_DATA_COLS)


@register("profile_bad_labels", "B5", _RAW + f"""
SELECT source_file, label, count(*) AS n FROM raw
WHERE NOT {_BLANK_SQL} AND (contains(label, chr(150)) OR contains(label, chr(65533)))
GROUP BY 1, 2""")
def q_profile_bad_labels(spark, sf):
    return PR.profile_bad_labels(raw_flows(spark, sf), RAW_DATA_COLS)


_NUM_MISSING = ("(CASE WHEN row_id IS NULL THEN 1 ELSE 0 END + CASE WHEN bytes IS NULL OR isnan(bytes) "
                "THEN 1 ELSE 0 END + CASE WHEN dst_port IS NULL THEN 1 ELSE 0 END)")


@register("profile_inf", "B6", _RAW + f"""
SELECT source_file, CAST(sum(CASE WHEN abs(bytes) = 'Infinity'::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS n_inf
FROM raw WHERE NOT {_BLANK_SQL} GROUP BY 1""")
def q_profile_inf(spark, sf):
    return PR.profile_inf_missing(raw_flows(spark, sf), RAW_DATA_COLS).select("source_file", "n_inf")


@register("profile_missing", "B7", _RAW + f"""
SELECT source_file, CAST(sum({_NUM_MISSING}) AS BIGINT) AS n_missing
FROM raw WHERE NOT {_BLANK_SQL} GROUP BY 1""")
def q_profile_missing(spark, sf):
    return PR.profile_inf_missing(raw_flows(spark, sf), RAW_DATA_COLS).select("source_file", "n_missing")


@register("profile_totals", "B8", _RAW + f"""
SELECT n_raw, n_blank, n_raw - n_blank AS n_real, n_duplicates,
       round(n_duplicates / greatest(n_raw - n_blank, 1), 6) AS duplicate_rate
FROM (SELECT CAST(sum(n) AS BIGINT) AS n_raw,
             CAST(coalesce(sum(CASE WHEN b THEN n END), 0) AS BIGINT) AS n_blank,
             CAST(coalesce(sum(CASE WHEN NOT b THEN n - 1 END), 0) AS BIGINT) AS n_duplicates
      FROM (SELECT source_file, {_BLANK_SQL} AS b, src, dst, ts, bytes, dst_port, label,
                   count(*) AS n FROM raw GROUP BY ALL) g) t""")
def q_profile_totals(spark, sf):
    return rounded(PR.profile_totals(raw_flows(spark, sf), RAW_DATA_COLS))


@register("distinct_counts", "B9", S.with_(S.FLOWS) + """
SELECT count(DISTINCT label) AS n_labels, count(DISTINCT src) AS n_sources,
       count(DISTINCT dst) AS n_destinations, count(DISTINCT day) AS n_days,
       count(*) AS n_flows FROM flows""")
def q_distinct_counts(spark, sf):
    f = events_flows(spark, sf)
    return f.agg(F.count_distinct("label").alias("n_labels"),
                 F.count_distinct("src").alias("n_sources"),
                 F.count_distinct("dst").alias("n_destinations"),
                 F.count_distinct("day").alias("n_days"),
                 F.count(F.lit(1)).alias("n_flows"))


@register("drop_blank_rows", "P1", _RAW + f"SELECT {_RAW_COLS} FROM raw WHERE NOT {_BLANK_SQL}")
def q_drop_blank_rows(spark, sf):
    return CL.drop_blank_rows(raw_flows(spark, sf)).select(*_RAW_COLS.split(", "))


@register("fix_label_encoding", "P2", _RAW + """
SELECT capture_pos, regexp_replace(replace(label, chr(150), '-'), '^\\s+|\\s+$', '', 'g') AS label
FROM raw""")
def q_fix_label_encoding(spark, sf):
    return CL.fix_label_encoding(raw_flows(spark, sf)).select("capture_pos", "label")


@register("coerce_inf", "P3", _RAW + """
SELECT capture_pos, CASE WHEN isnan(bytes) OR abs(bytes) = 'Infinity'::DOUBLE THEN NULL
                         ELSE round(bytes, 6) END AS bytes FROM raw""")
def q_coerce_inf(spark, sf):
    return rounded(CL.coerce_inf(raw_flows(spark, sf)).select("capture_pos", "bytes"))


_TS_STRINGS = """strs AS (
  SELECT row_id, CASE WHEN row_id % 2 = 0 THEN strftime(ts, '%-d/%-m/%Y %-I:%M')
                      ELSE strftime(ts, '%d/%m/%Y %I:%M:%S') END AS raw_ts FROM flows)"""


def _ts_strings(spark, sf):
    f = events_flows(spark, sf)
    return f.select("row_id", F.when(F.col("row_id") % 2 == 0, F.date_format("ts", "d/M/yyyy h:mm"))
                    .otherwise(F.date_format("ts", "dd/MM/yyyy hh:mm:ss")).alias("raw_ts"))


@register("parse_ambiguous_ts", "P4", S.with_(S.FLOWS, _TS_STRINGS) + """
SELECT row_id, raw_ts,
       make_timestamp(CAST(d[3] AS BIGINT), CAST(d[2] AS BIGINT), CAST(d[1] AS BIGINT),
                      CASE WHEN CAST(t[1] AS INTEGER) = 12 THEN 12
                           WHEN CAST(t[1] AS INTEGER) <= 7 THEN CAST(t[1] AS INTEGER) + 12
                           ELSE CAST(t[1] AS INTEGER) END,
                      CAST(t[2] AS BIGINT), coalesce(CAST(t[3] AS DOUBLE), 0)) AS parsed_ts
FROM (SELECT row_id, raw_ts, string_split(string_split(raw_ts, ' ')[1], '/') AS d,
             string_split(string_split(raw_ts, ' ')[2], ':') AS t FROM strs) s""")
def q_parse_ambiguous_ts(spark, sf):
    s = _ts_strings(spark, sf)
    return s.select("row_id", "raw_ts", C.parse_ambiguous_timestamp("raw_ts").alias("parsed_ts"))


@register("bucket_hour", "P5", S.with_(S.FLOWS) + "SELECT row_id, date_trunc('hour', ts) AS bucket FROM flows")
def q_bucket_hour(spark, sf):
    return events_flows(spark, sf).select("row_id", C.bucket_floor("ts", "1 hour").alias("bucket"))


@register("bucket_5min", "P5", S.with_(S.FLOWS) +
          "SELECT row_id, time_bucket(INTERVAL '5 minutes', ts) AS bucket FROM flows")
def q_bucket_5min(spark, sf):
    return events_flows(spark, sf).select("row_id", C.bucket_floor("ts", "5 minutes").alias("bucket"))


@register("binary_label", "P7", S.with_(S.FLOWS) + """
SELECT label, CASE WHEN label IS NOT DISTINCT FROM 'BENIGN' THEN 0 ELSE 1 END AS y, count(*) AS n
FROM flows GROUP BY 1, 2""")
def q_binary_label(spark, sf):
    f = events_flows(spark, sf)
    return f.groupBy("label", C.binary_label("label").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@register("internal_ip", "P10", S.with_(S.FLOWS) + """
SELECT host, starts_with(host, '192.168.') AS is_internal
FROM (SELECT src AS host FROM flows UNION SELECT dst FROM flows) h""")
def q_internal_ip(spark, sf):
    f = events_flows(spark, sf)
    hosts = f.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    return hosts.select("host", C.is_internal_ip("host").alias("is_internal"))


@register("derived_bytes", "P6", _RAW + """
SELECT capture_pos, round(CASE WHEN NOT (isnan(bytes) OR abs(bytes) = 'Infinity'::DOUBLE) THEN bytes END
                          + CAST(dst_port AS DOUBLE), 6) AS total_bytes FROM raw""")
def q_derived_bytes(spark, sf):
    """Forward plus backward bytes of the raw flows (the port stands in for the backward
    count, which the given tables lack); missing where either is."""
    raw = CL.coerce_inf(raw_flows(spark, sf))
    return rounded(raw.select("capture_pos", C.derived_bytes("bytes", "dst_port").alias("total_bytes")))


@register("day_split", "P11,S3", S.with_(S.FLOWS) + """
SELECT CASE WHEN day IN ('Monday', 'Tuesday', 'Wednesday') THEN 'train' ELSE 'test' END AS side,
       label, count(*) AS n
FROM flows WHERE day IN ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday') GROUP BY 1, 2""")
def q_day_split(spark, sf):
    from ..operators.splits import day_split
    f = day_split(events_flows(spark, sf))
    return f.groupBy("side", "label").agg(F.count(F.lit(1)).alias("n"))
