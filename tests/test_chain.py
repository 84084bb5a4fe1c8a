import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hostgraph.functions.columns import is_internal_ip
from hostgraph.operators import chain as CH
from hostgraph.operators import mttd as MT

DAY = dt.datetime(2023, 3, 14)


def at(minute, micros=0):
    return DAY + dt.timedelta(minutes=minute, microseconds=micros)


def sources(spark, names):
    return spark.createDataFrame([(n, "Worm") for n in names] + [("z", "BENIGN")], "src string, label string")


def test_patient_zero(spark):
    assert CH.find_patient_zero(sources(spark, ["q7"] * 3), "Worm") == "q7"
    for names in (["q7", "q8", "q7"], []):
        with pytest.raises(ValueError):
            CH.find_patient_zero(sources(spark, names), "Worm")


def test_window_raises_on_use_when_sources_differ(spark):
    df = spark.createDataFrame([("p", "Worm", "x", at(3)), ("q", "Worm", "y", at(4))],
                               "src string, label string, dst string, ts timestamp_ntz")
    with pytest.raises(Exception, match="single source"):
        CH.compromise_window(df, "Worm").collect()
    one = CH.compromise_window(df.where("src = 'p'"), "Worm").first()
    assert (one.patient_zero, one.compromise_start, one.n_flows, one.n_destinations) == ("p", at(3), 1, 1)


def test_internal_addresses_by_prefix(spark):
    ips = ["192.168.0.1", "192.168.77.200", "8.8.4.4", "1.192.168.5", "192.169.0.1", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "k int, ip string")
    got = [r.i for r in df.select("k", is_internal_ip("ip").alias("i")).orderBy("k").collect()]
    assert got[:5] == [True, True, False, False, False] and not got[5]


def brute(rows, host, t0):
    """Walk one host's flows in order with a set of destinations met so far."""
    own = sorted((r for r in rows if r[1] == host and r[3] is not None), key=lambda r: (r[3], r[0]))
    met, out = {r[2] for r in own if r[3] < t0}, []
    prior = len(met)
    for r in own:
        if r[3] >= t0:
            out.append((r[0], r[2] not in met, len(met | {r[2]}), prior))
            met.add(r[2])
    return out


def random_flows(seed):
    rng = random.Random(seed)
    ends = ["192.168.4.%d" % i for i in range(6)] + ["9.9.9.%d" % i for i in range(4)] + [None]
    return [(i, rng.choice(["h1", "h1", "h2"]), rng.choice(ends), None if rng.random() < 0.05 else at(rng.randrange(90)))
            for i in range(120)]


@pytest.mark.parametrize("seed", [1, 2])
def test_timeline_against_a_walk(spark, seed):
    """Ties in time, destinations that are missing, flows without a time."""
    rows = random_flows(seed)
    df = spark.createDataFrame(rows, "row_id long, src string, dst string, ts timestamp_ntz")
    tl = CH.post_compromise_timeline(df, "h1", at(30), chunks=4).orderBy("ts", "row_id").collect()
    assert [(r.row_id, r.is_novel_destination, r.cumulative_distinct_destinations, r.n_prior_destinations)
            for r in tl] == brute(rows, "h1", at(30))


def test_rows_without_destination_stay(spark):
    rows = [(1, "h", None, at(1)), (2, "h", None, at(2)), (3, "h", "d", at(3))]
    df = spark.createDataFrame(rows, "row_id long, src string, dst string, ts timestamp_ntz")
    tl = CH.post_compromise_timeline(df, "h", at(0)).orderBy("row_id").collect()
    assert [r.is_novel_destination for r in tl] == [True, False, True]


def detections(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, flagged boolean, inner boolean")


def test_first_detection(spark):
    df = detections(spark, [(at(51), True, False), (at(17), True, True), (at(4), False, True), (at(9), True, False)])
    assert MT.first_detection_time(df).first()[0] == at(9)
    assert MT.first_detection_time(df, mask=F.col("inner")).first()[0] == at(17)
    assert MT.first_detection_time(df, mask=F.lit(False)).first()[0] is None
    assert MT.first_detection_time(df.where("NOT flagged")).first()[0] is None


@pytest.mark.parametrize("cutoff", [at(1), at(22), at(23), at(400), None])
def test_hosts_reached_by(spark, cutoff):
    firsts = [at(2), at(22), at(22), at(23), at(61)]
    df = spark.createDataFrame([(x,) for x in firsts], "first_contact timestamp_ntz")
    got = df.agg(MT.hosts_reached_by(F.lit(cutoff).cast("timestamp_ntz"))).first()[0]
    assert got == (0 if cutoff is None else sum(x <= cutoff for x in firsts))


def test_latencies_are_exact(spark):
    """Fractions of seconds are neither floored at the ends nor rounded between them."""
    rows = [(1, "h", "192.168.4.1", at(5, 900_000), False, True), (2, "h", "7.7.7.7", at(6, 100_000), True, True),
            (3, "h", "192.168.4.2", at(9, 250_000), True, True), (4, "h", "192.168.4.3", at(40), True, True)]
    tl = spark.createDataFrame(rows, "row_id long, src string, dst string, ts timestamp_ntz, flagged boolean, "
                                     "is_novel_destination boolean")
    r = MT.mttd_table(tl).first()
    assert (r.latency_any_s, r.latency_chain_s, r.gap_s) == pytest.approx((59.2, 239.35, 180.15), abs=1e-9)
    assert (r.hosts_reached_any, r.hosts_reached_chain, r.n_pivots) == (1, 2, 3)
    none = MT.mttd_table(tl.withColumn("flagged", F.lit(False))).first()
    assert none.latency_any_s is None and none.hosts_reached_any == 0
