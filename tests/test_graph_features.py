"""Edges, host-bucket statistics and baselines against plain Python on random flows."""
import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hostgraph.operators import edges as E
from hostgraph.operators import features as FT

START = dt.datetime(2023, 3, 14, 22)
STATS = ("bucket timestamp_ntz, host string, fan_out long, fan_in long, flow_volume long, byte_volume double, "
         "novelty_score double")


def hour(i):
    return START + dt.timedelta(hours=i)


def random_flows(seed, n=150):
    rng = random.Random(seed)
    hosts = ["k%d" % i for i in range(7)]
    return [(rng.choice(hosts), rng.choice(hosts + [None]), hour(rng.randrange(5)) + dt.timedelta(seconds=rng.randrange(3600)),
             None if rng.random() < 0.1 else float(rng.randrange(1, 400)) / 4) for _ in range(n)]


def brute_edges(rows):
    out = defaultdict(lambda: [0, 0.0])
    for s, d, t, b in rows:
        if d is not None:
            e = out[t.replace(minute=0, second=0), s, d]
            e[0] += 1
            e[1] += b or 0.0
    return {k: tuple(v) for k, v in out.items()}


def brute_stats(edges):
    first = {}
    for b, s, d in sorted(edges):
        first.setdefault((s, d), b)
    out = {}
    for b in sorted({k[0] for k in edges}):
        for h in sorted({x for k in edges if k[0] == b for x in k[1:]}):
            own = {k: v for k, v in edges.items() if k[0] == b and k[1] == h}
            new = sum(first[s, d] == b for _, s, d in own)
            out[b, h] = (len(own), sum(k[0] == b and k[2] == h for k in edges), sum(v[0] for v in own.values()),
                         sum(v[1] for v in own.values()), new / len(own) if own else None)
    return out


def frames(spark, seed):
    rows = random_flows(seed)
    df = spark.createDataFrame(rows, "src string, dst string, ts timestamp_ntz, bytes double")
    return rows, E.build_edges(df.repartition(3))


@pytest.mark.parametrize("seed", [1, 2])
def test_edges(spark, seed):
    rows, edges = frames(spark, seed)
    got = {(r.bucket, r.src, r.dst): (r.flow_count, r.total_bytes) for r in edges.collect()}
    assert got == brute_edges(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_host_bucket_stats(spark, seed):
    rows, edges = frames(spark, seed)
    want = brute_stats(brute_edges(rows))
    got = {(r.bucket, r.host): (r.fan_out, r.fan_in, r.flow_volume, r.byte_volume, r.novelty_score)
           for r in FT.host_bucket_stats(edges).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    assert sum(v[0] for v in got.values()) == sum(v[1] for v in got.values()) == edges.count()


def test_a_loop_is_one_edge_out_and_one_in(spark):
    e = spark.createDataFrame([(hour(0), "k", "k", 6, 12.5)], "bucket timestamp_ntz, src string, dst string, flow_count long, total_bytes double")
    assert tuple(FT.host_bucket_stats(e).first())[2:] == (1, 1, 6, 12.5, 1.0)


def stats(spark, rows):
    return spark.createDataFrame([(hour(b), h, fo, fi, 0, 0.0, nv) for b, h, fo, fi, nv in rows], STATS)


def test_degree_ratio_looks_one_bucket_back(spark):
    """The bucket before is that of the whole table; a host that was not in it has no ratio."""
    rows = [(0, "k", 3, 2, None), (1, "k", 6, 9, None), (3, "k", 1, 2, None), (2, "m", 7, 0, None), (3, "m", 5, 9, None)]
    got = {(r.bucket, r.host): r.degree_ratio_change for r in FT.add_baselines(stats(spark, rows)).collect()}
    assert got == {(hour(0), "k"): None, (hour(1), "k"): 3.0, (hour(3), "k"): None, (hour(2), "m"): None, (hour(3), "m"): 2.0}


def score(history, now, eps):
    known = [v for v in history if v is not None]
    if now is None or len(known) < 2:
        return None
    return (now - statistics.mean(known)) / (statistics.stdev(known) + eps)


@pytest.mark.parametrize("seed,eps", [(5, 1.0), (6, 0.05), (7, 1e-6)])
def test_baseline_uses_strictly_earlier_values(spark, seed, eps):
    rng = random.Random(seed)
    values = [None if rng.random() < 0.2 else float(rng.randrange(40)) / 2 for _ in range(25)] + [13.5] * 4 + [640.0]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double").withColumn("h", F.lit("k"))
    w = Window.partitionBy("h").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    got = [r.z for r in df.select("k", FT.baseline_zscore("v", eps, w).alias("z")).orderBy("k").collect()]
    for i, z in enumerate(got):
        want = score(values[:i], values[i], eps)
        assert (z is None) == (want is None)
        assert z is None or z == pytest.approx(want, rel=1e-9)


def test_a_constant_past(spark):
    """No spread: the distance is measured in units of the guard alone."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 3.0, 3.0, 3.25, 3.0])], "k int, v double").withColumn("h", F.lit("k"))
    w = Window.partitionBy("h").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    z = [r.z for r in df.select("k", FT.baseline_zscore("v", 0.5, w).alias("z")).orderBy("k").collect()]
    assert z[:2] == [None, None] and z[2] == 0.0 and z[3] == 0.5


def test_all_baselines_of_a_table(spark):
    rng = random.Random(8)
    rows = [(b, h, rng.randrange(9), rng.randrange(9), None if rng.random() < 0.4 else rng.randrange(5) / 4)
            for h in ("k", "m") for b in range(9) if h == "k" or b % 3]
    got = {(r.bucket, r.host): r for r in FT.add_baselines(stats(spark, rows)).collect()}
    for col, at, eps in (("fan_out", 2, 1.0), ("fan_in", 3, 1.0), ("novelty", 4, 0.05)):
        for h in ("k", "m"):
            own = sorted(r for r in rows if r[1] == h)
            for i, r in enumerate(own):
                want = score([x[at] for x in own[:i]], r[at], eps)
                z = got[hour(r[0]), h][f"{col}_zscore"]
                assert z == (None if want is None else pytest.approx(want, rel=1e-9))


def test_top_k(spark):
    rows = [(0, "k%02d" % i, (i * 7) % 23, 0, None) for i in range(23)]
    top = FT.top_k(stats(spark, rows), "fan_out", 6).collect()
    assert [r.fan_out for r in top] == [22, 21, 20, 19, 18, 17]
