import datetime as dt
import random

from hostgraph.operators.enrich import enrich_flows, feature_key_guard
from hostgraph.operators.features import FEATURE_COLUMNS

HOURS = [dt.datetime(2023, 3, 14, h) for h in (2, 3, 21)]
HOSTS = ["n%d" % i for i in range(5)]


def table(seed=6):
    """Features of some (bucket, host) keys, each value telling where it belongs."""
    rng = random.Random(seed)
    keys = [(b, h) for b in HOURS for h in HOSTS if rng.random() < 0.6]
    return {k: [1000.0 * i + j for j in range(len(FEATURE_COLUMNS))] for i, k in enumerate(keys)}


def features(spark, values):
    cols = ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    return spark.createDataFrame([(*k, *v) for k, v in values.items()], f"bucket timestamp_ntz, host string, {cols}")


def flows(spark, seed=9):
    rng = random.Random(seed)
    rows = [(i, rng.choice(HOSTS + [None]), rng.choice(HOSTS), rng.choice(HOURS + [None])) for i in range(40)]
    return rows, spark.createDataFrame(rows, "row_id long, src string, dst string, bucket timestamp_ntz")


def test_every_flow_once_with_its_own_ends(spark):
    values = table()
    rows, df = flows(spark)
    out = enrich_flows(df, features(spark, values))
    got = {r.row_id: r for r in out.collect()}
    assert len(got) == out.count() == len(rows)
    for i, s, d, b in rows:
        for side, host in (("src_", s), ("dst_", d)):
            want = values.get((b, host), [None] * len(FEATURE_COLUMNS))
            assert [got[i][side + c] for c in FEATURE_COLUMNS] == want


def test_key_guard(spark):
    f = features(spark, table())
    again = f.limit(3)
    assert feature_key_guard(f).count() == 0
    assert feature_key_guard(f.unionByName(again)).count() == 3
