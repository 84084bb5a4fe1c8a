import datetime as dt
import os
import tempfile

import pytest

from hostgraph.sources import csv_source as CSV
from hostgraph.streaming import edges_stream as ES
from hostgraph.streaming import novelty_stream as NS


def _flow_files(spark, rows):
    d = tempfile.mkdtemp(prefix="hg-stream-")
    df = spark.createDataFrame(rows, "row_id long, src string, dst string, ts timestamp, bytes double")
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(d, "in"))
    return d, df.schema


def test_stream_novelty_emits_first_contact_per_pair(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(1, "a", "x", t + dt.timedelta(minutes=5), 1.0), (2, "a", "x", t, 1.0),
            (3, "a", "y", t, 1.0), (4, "b", "x", t, 1.0), (5, "a", "y", t, 1.0)]
    d, schema = _flow_files(spark, rows)
    stream = spark.readStream.schema(schema).parquet(os.path.join(d, "in"))
    out = os.path.join(d, "out")
    NS.drain_novel_flows(stream, out, os.path.join(d, "ck"))
    assert sorted(r.row_id for r in spark.read.parquet(out).collect()) == [2, 3, 4]
    # a later feed: only pairs that no earlier batch has emitted
    more = [(6, "a", "x", t, 1.0), (7, "c", "x", t, 1.0), (8, "c", "x", t, 1.0), (9, None, "x", t, 1.0), (10, None, "x", t, 1.0)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
    NS.drain_novel_flows(spark.readStream.schema(schema).parquet(os.path.join(d, "in")), out, os.path.join(d, "ck"))
    assert sorted(r.row_id for r in spark.read.parquet(out).collect()) == [2, 3, 4, 7, 9]


def test_stream_novelty_forgets_silent_pairs(spark):
    """A pair without flows for two hours of event time counts as new again; a lively one does not."""
    t = dt.datetime(2024, 1, 1, 10)
    h = dt.timedelta(hours=1)
    feeds = [[(1, "a", "x", t, 1.0), (2, "b", "x", t, 1.0)], [(3, "b", "x", t + 1.5 * h, 1.0)],
             [(4, "c", "x", t + 2.6 * h, 1.0)], [(5, "a", "x", t + 2.7 * h, 1.0), (6, "b", "x", t + 2.7 * h, 1.0)]]
    d, schema = _flow_files(spark, feeds[0])
    out = os.path.join(d, "out")
    for feed in feeds:
        if feed is not feeds[0]:
            spark.createDataFrame(feed, schema).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
        NS.drain_novel_flows(spark.readStream.schema(schema).parquet(os.path.join(d, "in")), out, os.path.join(d, "ck"),
                             forget_after="2 hours", delay="1 minute")
    assert sorted(r.row_id for r in spark.read.parquet(out).collect()) == [1, 2, 4, 5]


def test_stream_novelty_reads_no_history(spark):
    """No plan of the stream scans what it has emitted."""
    t = dt.datetime(2024, 1, 1, 10)
    d, schema = _flow_files(spark, [(1, "a", "x", t, 1.0)])
    stream = NS.novel_flows(spark.readStream.schema(schema).parquet(os.path.join(d, "in")))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.count("FileSource[") == 1 and "TransformWithState" in plan


def test_stream_edges_only_closed_windows(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(1, "a", "x", t + dt.timedelta(minutes=1), 2.0), (2, "a", "x", t + dt.timedelta(minutes=2), 3.0),
            (3, "a", "x", t + dt.timedelta(hours=1, minutes=5), 1.0),
            (4, "b", "y", t + dt.timedelta(hours=3), 1.0)]
    d, schema = _flow_files(spark, rows)
    stream = spark.readStream.schema(schema).parquet(os.path.join(d, "in"))
    out = os.path.join(d, "out")
    ES.run_to_table(ES.windowed_edges(stream, "1 hour", "10 minutes"), out, os.path.join(d, "ck"))
    got = {(r.bucket, r.src, r.dst): (r.flow_count, r.total_bytes) for r in spark.read.parquet(out).collect()}
    # watermark = 13:00 - 10 min: the 10:00 and 11:00 windows are closed, 13:00 is still open
    assert got == {(dt.datetime(2024, 1, 1, 10), "a", "x"): (2, 5.0),
                   (dt.datetime(2024, 1, 1, 11), "a", "x"): (1, 1.0)}


def test_stream_edges_complete_has_open_windows(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(1, "a", "x", t, 2.0), (2, "a", "x", t + dt.timedelta(hours=3), 3.0), (3, "a", "x", t + dt.timedelta(hours=3), None)]
    d, schema = _flow_files(spark, rows)
    out = os.path.join(d, "out")
    for late in ([], [(4, "a", "x", t, 5.0)]):          # a late row counts like any other
        if late:
            spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
        ES.drain_partial_edges(spark.readStream.schema(schema).parquet(os.path.join(d, "in")), out, os.path.join(d, "ck"))
        got = {r.bucket.hour: (r.flow_count, r.total_bytes)
               for r in ES.windowed_edges_complete(spark.read.parquet(out)).collect()}
        assert got == {10: (2, 7.0) if late else (1, 2.0), 13: (2, 3.0)}


FILES = ["Monday-WorkingHours.pcap_ISCX.csv", "Friday-WorkingHours-Morning.pcap_ISCX.csv"]


def test_csv_capture_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="hg-csv-")
    raw = spark.createDataFrame([(1, " 10.0.0.1", float("inf"), "  Web Attack \x96 XSS ", FILES[0]),
                                 (None, None, None, "BENIGN", FILES[1])],
                                "row_id long, src string, bytes double, label string, source_file string")
    CSV.write_capture(raw, d)
    assert sorted(f for f in os.listdir(d) if f.endswith(".csv")) == sorted(FILES)      # a flat folder
    back = CSV.scan_capture(spark, d, CSV.capture_schema(raw))
    assert sorted(back.columns) == sorted(raw.columns)
    got = {r.source_file: (r.row_id, r.src, r.bytes, r.label) for r in back.collect()}
    assert got == {FILES[0]: (1, " 10.0.0.1", float("inf"), "  Web Attack \x96 XSS "), FILES[1]: (None, None, None, "BENIGN")}


def test_capture_file_of_several_parts(spark):
    d = tempfile.mkdtemp(prefix="hg-csv-")
    raw = spark.range(200).selectExpr("id AS row_id", "'h' AS src", f"if(id % 10 = 0, '{FILES[1]}', '{FILES[0]}') AS source_file").repartition(4)
    CSV.write_capture(raw, d)
    assert len([f for f in os.listdir(d) if f.endswith(".csv")]) > 4
    back = CSV.scan_capture(spark, d, CSV.capture_schema(raw))
    assert sorted(map(tuple, back.select("row_id", "source_file").collect())) == sorted(
        map(tuple, raw.select("row_id", "source_file").collect()))
    one = CSV.scan_capture(spark, f"{d}/{FILES[1]}", CSV.capture_schema(raw))
    assert sorted(r.row_id for r in one.collect()) == list(range(0, 200, 10))


def test_columns_go_by_header(spark, tmp_path):
    """Files whose columns stand in another order, or lack one, keep their values apart."""
    raw = spark.createDataFrame([], "row_id long, src string, bytes double, label string, source_file string")
    (tmp_path / FILES[0]).write_text(" Row ID, Source IP,Total Bytes , Label\n1,h1,2.5,BENIGN\n")
    (tmp_path / FILES[1]).write_text("Label , Total Bytes, Row ID,Source IP\nWorm,7.25,2,h2\n")
    (tmp_path / "short.csv").write_text(" Label, Row ID\nWorm,3\n")
    got = CSV.scan_capture(spark, str(tmp_path), CSV.capture_schema(raw)).collect()
    assert {(r.row_id, r.src, r.bytes, r.label, r.source_file) for r in got} == {
        (1, "h1", 2.5, "BENIGN", FILES[0]), (2, "h2", 7.25, "Worm", FILES[1]), (3, None, None, "Worm", "short.csv")}
    (tmp_path / "odd.csv").write_text("Row ID,Colour\n4,red\n")
    with pytest.raises(ValueError, match="colour"):
        CSV.scan_capture(spark, str(tmp_path), CSV.capture_schema(raw))


def test_normalise_header():
    assert CSV.normalise_header(" Source IP") == "source_ip"
    assert CSV.normalise_header("Flow Bytes/s ") == "flow_bytes_s"


def test_stream_novelty_keeps_ids_beside_missing_ones(spark):
    """Rows of a pair reach its state as rows, with their ids whole; equal times go by id, a missing id last."""
    t = dt.datetime(2024, 1, 1, 10, 0, 0, 123457)
    rows = [(None, "a", "x", t, 1.0), (2 ** 60 + 1, "a", "x", t, 1.0), (2 ** 60 + 3, "a", "x", t, 1.0), (None, "b", "x", t, 1.0),
            (4, None, None, t, 1.0), (5, "c", "x", None, 1.0)]
    d, schema = _flow_files(spark, rows)
    feed = spark.readStream.schema(schema).parquet(os.path.join(d, "in"))
    out = os.path.join(d, "out")
    NS.drain_novel_flows(feed, out, os.path.join(d, "ck"))
    got = {(r.row_id, r.src, r.dst, r.ts) for r in spark.read.parquet(out).collect()}
    assert got == {(2 ** 60 + 1, "a", "x", t), (None, "b", "x", t), (4, None, None, t)}
