import datetime as dt
import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from hostgraph.operators import splits as SP


def _buckets(spark, n=35, seed=4):
    """Buckets of very different size."""
    rng = random.Random(seed)
    t0 = dt.datetime(2022, 12, 30, 17)
    rows, k = [], 0
    for i in range(n):
        for _ in range(rng.choice([1, 2, 9, 60])):
            rows.append((k, t0 + dt.timedelta(hours=3 * i)))
            k += 1
    return spark.createDataFrame(rows, "row_id long, bucket timestamp_ntz")


def test_group_split_moves_whole_buckets(spark):
    df = _buckets(spark)
    sides = {}
    got = SP.group_split(df, "bucket", 0.3, 5).collect()
    assert sorted(r.row_id for r in got) == sorted(r.row_id for r in df.collect())
    for r in got:
        assert sides.setdefault(r.bucket, r.is_test) == r.is_test
    assert sum(sides.values()) == 10                # 30 % of 35, half to even
    again = {r.bucket: r.is_test for r in SP.group_split(df.repartition(7), "bucket", 0.3, 5).collect()}
    assert again == sides
    other = {r.bucket: r.is_test for r in SP.group_split(df, "bucket", 0.3, 6).collect()}
    assert other != sides


def test_group_split_has_a_test_group_at_least(spark):
    sides = {r.bucket: r.is_test for r in SP.group_split(_buckets(spark, 4), "bucket", 0.001, 5).collect()}
    assert sum(sides.values()) == 1


def test_null_keys_lose_no_row(spark):
    rows = [(i, [None, "u", "v"][i % 3], None if i % 4 == 0 else dt.datetime(2022, 1, 1 + i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, label string, bucket timestamp_ntz")
    s = SP.stratified_split(df, ["label"], "row_id", 0.25, 1)
    assert {r.label: (r.n, r.t) for r in s.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()} == {None: (20, 5), "u": (20, 5), "v": (20, 5)}
    g = SP.group_split(df, "bucket", 0.25, 1)
    assert g.count() == 60 and g.groupBy("bucket").agg(F.count_distinct("is_test").alias("k")).where("k > 1").count() == 0
    assert SP.hash_rank(df, ["label"], "row_id").count() == 60
    assert SP.holdout_class(df, "label", "u", "row_id", 0.25, 1).count() == 60
    sample = SP.stratified_sample(df, "label", 7, "row_id", 1)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {None: 7, "u": 7, "v": 7}


def test_hash_rank_equals_row_number(spark):
    rows = [(i, "A" if i % 3 else "B") for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, label string")
    r = SP.hash_rank(df, ["label"], "row_id", 7)
    w = Window.partitionBy("label").orderBy(SP.seeded_hash("row_id", 7), "row_id")
    ref = df.withColumn("rn", F.row_number().over(w))
    bad = r.join(ref, ["row_id", "label"]).where(F.col("rn") != F.col("hash_rank")).count()
    assert bad == 0
    sizes = {x.label: x.group_size for x in r.select("label", "group_size").distinct().collect()}
    assert sizes == {"A": 1333, "B": 667}


def test_stratified_split_exact_per_stratum(spark):
    sizes = {"p": 423, "q": 65, "r": 3, "s": 1}
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    s = SP.stratified_split(spark.createDataFrame(rows, "row_id string, label string"), ["label"], "row_id", 0.3, 11)
    got = {r.label: r.n for r in s.groupBy("label").agg(F.count_if("is_test").alias("n")).collect()}
    assert got == {"p": 127, "q": 20, "r": 1, "s": 0}       # 126.9, 19.5 to even, 0.9, 0.3


@pytest.mark.parametrize("cap", [1, 40, 90, 5000])
def test_stratified_sample_is_the_head_of_the_hash_order(spark, cap):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaaaab")) for i in range(900)] + [(1000, "c")]
    df = spark.createDataFrame(rows, "row_id long, label string")
    w = Window.partitionBy("label").orderBy(SP.seeded_hash("row_id", 8), "row_id")
    want = {r.row_id for r in df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).collect()}
    got = SP.stratified_sample(df.repartition(5), "label", cap, "row_id", 8)
    assert got.columns == df.columns
    assert {r.row_id for r in got.collect()} == want
    whole = SP.stratified_sample(df, None, cap, "row_id", 8)
    assert whole.count() == min(cap, 901)


def test_day_split_sides(spark):
    df = spark.createDataFrame([("Monday",), ("Thursday",), ("Sunday",)], "day string")
    got = {r.day: r.side for r in SP.day_split(df).collect()}
    assert got == {"Monday": "train", "Thursday": "test"}


def test_loco_fold_sizes(spark):
    rows = [(i, "BENIGN", i % 4 > 0) for i in range(48)] + [(100 + i, "x", False) for i in range(7)] \
        + [(200 + i, "y", False) for i in range(2)] + [(300 + i, "z", False) for i in range(31)]
    df = spark.createDataFrame(rows, "row_id long, label string, is_benign_train boolean")
    got = {r.held_out_class: (r.n_train, r.n_test) for r in SP.loco_fold_sizes(df).collect()}
    assert got == {"x": (36 + 33, 7), "y": (36 + 38, 2), "z": (36 + 9, 31)}
