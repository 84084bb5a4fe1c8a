import random

from pyspark.sql import functions as F

from hostgraph.operators import sketches as SK


def test_merged_summaries(spark):
    rng = random.Random(1)
    rows = [(f"d{i % 5}", rng.choice([None, float("nan"), float("inf"), rng.gauss(0, 1), 3.0]), rng.choice([None, f"h{rng.randrange(3000)}"]))
            for i in range(20000)]
    df = spark.createDataFrame(rows, "day string, v double, host string")
    daily = SK.summarise(df, "day", ["v"], ["host"])
    some = daily.where("day IN ('d1', 'd3')")
    got = SK.merge(some, ["v"], ["host"]).select("n", SK.quantile("v", 0.5).alias("median"), SK.distinct("host").alias("hosts")).first()
    own = [r for r in rows if r[0] in ("d1", "d3")]
    values = sorted(v for _, v, _ in own if v is not None and v == v and v != float("inf"))
    low, high = (sum(op(v) for v in values) / len(values) for op in (lambda v: v < got.median, lambda v: v <= got.median))
    assert got.n == len(own) and low - SK.RANK_ERROR <= 0.5 <= high + SK.RANK_ERROR
    assert got.hosts == len({h for _, _, h in own if h})                   # fewer than the sketch holds: exact
    a, b = (daily.where(F.col("day") == d).select(F.col("host_distinct").alias(d)) for d in ("d1", "d2"))
    shared = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").select(SK.overlap(F.col("d1"), F.col("d2"))).first()[0]
    assert shared == len({h for d, _, h in rows if d == "d1" and h} & {h for d, _, h in rows if d == "d2" and h})


def test_group_without_values_and_empty_table(spark):
    df = spark.createDataFrame([("a", None, None), ("a", float("nan"), None)], "day string, v double, host string")
    s = SK.summarise(df, "day", ["v"], ["host"])
    assert tuple(s.select("n", SK.quantile("v", 0.5), SK.distinct("host")).first()) == (2, None, 0)
    assert SK.summarise(df.limit(0), "day", ["v"], ["host"]).count() == 0
