import datetime as dt
import random

import pytest

from hostgraph.operators import features as FT
from hostgraph.operators.online import OnlineFeatures
from hostgraph.session import scratch_path

DAY = dt.timedelta(days=1)
B0 = dt.datetime(2024, 1, 1)
SCHEMA = "bucket timestamp_ntz, src string, dst string, flow_count long, total_bytes double"


def edge_rows(seed, buckets):
    rng = random.Random(seed)
    rows = []
    for b in range(buckets):
        if b == 4:
            continue                                   # a bucket without any edge
        pairs = {(f"h{rng.randrange(7)}", f"h{rng.randrange(7)}") for _ in range(rng.randrange(1, 14))}
        rows += [(B0 + b * DAY, s, d, rng.randint(1, 9), rng.choice([0.0, 1e9, rng.uniform(0, 100)])) for s, d in sorted(pairs)]
    return rows


def table(df):
    cols = ["bucket", "host", "fan_out", "fan_in", "flow_volume", "byte_volume", "novelty_score", "degree_ratio_change",
            "fan_out_zscore", "fan_in_zscore", "novelty_zscore", "flow_volume_zscore", "byte_volume_zscore"]
    return {(r[0], r[1]): r[2:] for r in map(tuple, df.select(*cols).collect())}


@pytest.mark.parametrize("cuts", [[1, 2, 3, 5, 8], []])
def test_batches_equal_the_whole_history(spark, cuts):
    """Bucket by bucket and in batches, and all at once."""
    rows = edge_rows(1, 12)
    want = table(FT.add_baselines(FT.host_bucket_stats(spark.createDataFrame(rows, SCHEMA))))
    online = OnlineFeatures(spark, path := scratch_path(spark, "online"))
    bounds = [0, *cuts, 12]
    for a, b in zip(bounds, bounds[1:]):
        part = [r for r in rows if B0 + a * DAY <= r[0] < B0 + b * DAY]
        online.advance(spark.createDataFrame(part, SCHEMA))
        online = OnlineFeatures(spark, path)           # as another job would open it
    got = table(online.features())
    assert got.keys() == want.keys()
    for k in want:
        assert [x is None for x in got[k]] == [x is None for x in want[k]], k
        assert [x for x in got[k] if x is not None] == pytest.approx([x for x in want[k] if x is not None], rel=1e-7, abs=1e-7), k


def test_late_bucket_and_failed_batch(spark):
    rows = edge_rows(2, 6)
    online = OnlineFeatures(spark, path := scratch_path(spark, "online"))
    first = spark.createDataFrame([r for r in rows if r[0] < B0 + 3 * DAY], SCHEMA)
    online.advance(first)
    with pytest.raises(ValueError):
        online.advance(first)
    assert online.advance(first.limit(0)).count() == 0 and online.version == 1
    # what a batch that stopped half-way has left is not seen, and is replaced
    spark.createDataFrame([("h0", "never")], "src string, dst string").write.parquet(f"{path}/pairs/v=2")
    again = OnlineFeatures(spark, path)
    assert again.pairs().where("dst = 'never'").count() == 0
    again.advance(spark.createDataFrame([r for r in rows if r[0] >= B0 + 3 * DAY], SCHEMA))
    assert again.pairs().where("dst = 'never'").count() == 0
    assert table(again.features()).keys() == table(FT.host_bucket_stats(spark.createDataFrame(rows, SCHEMA)).selectExpr(
        "*", "0 degree_ratio_change", *[f"0 {z}" for z in ("fan_out_zscore", "fan_in_zscore", "novelty_zscore",
                                                           "flow_volume_zscore", "byte_volume_zscore")])).keys()
