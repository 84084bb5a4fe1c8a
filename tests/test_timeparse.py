import datetime as dt

import pytest

from hostgraph.functions.columns import bucket_floor, parse_ambiguous_timestamp


def parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, raw string")
    return [r.t for r in df.select("k", parse_ambiguous_timestamp("raw").alias("t")).orderBy("k").collect()]


def test_every_hour_of_a_twelve_hour_clock(spark):
    """1 to 7 are afternoon, 8 to 11 morning, 12 is noon; with and without padding and seconds."""
    texts, want = [], []
    for hour in range(1, 13):
        real = hour + 12 if hour <= 7 else hour
        texts += [f"21/11/2022 {hour}:{hour + 20}", f"02/01/2023 {hour:02d}:07:{hour + 40}"]
        want += [dt.datetime(2022, 11, 21, real, hour + 20), dt.datetime(2023, 1, 2, real, 7, hour + 40)]
    assert parse(spark, texts) == want


def test_day_comes_before_month(spark):
    assert parse(spark, ["4/12/2021 10:30", "12/4/2021 10:30"]) == [dt.datetime(2021, 12, 4, 10, 30), dt.datetime(2021, 4, 12, 10, 30)]


@pytest.mark.parametrize("ts", [dt.datetime(2022, 2, 28, 23, 59, 59, 999999), dt.datetime(1968, 7, 30, 5, 4, 3),
                                dt.datetime(2000, 1, 1)])
def test_bucket_floor(spark, ts):
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    r = df.select(bucket_floor("ts", "1 hour").alias("h"), bucket_floor("ts", "5 minutes").alias("m"),
                  bucket_floor("ts", "1 day").alias("d"), bucket_floor("ts", "month").alias("mo")).first()
    assert r.h == ts.replace(minute=0, second=0, microsecond=0)
    assert r.m == ts.replace(minute=ts.minute // 5 * 5, second=0, microsecond=0)
    assert r.d == dt.datetime(ts.year, ts.month, ts.day)
    assert r.mo == dt.datetime(ts.year, ts.month, 1)
