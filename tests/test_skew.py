"""Hot keys: one host sends 40 % of all flows, one pair carries 30 %.  Results must equal a
brute-force pandas computation (nothing dropped, capped or sampled)."""
import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from hostgraph.operators import chain as CH
from hostgraph.operators import edges as E
from hostgraph.operators import features as FT
from hostgraph.operators.novelty import flow_novelty
from hostgraph.operators.splits import stratified_sample

T0 = dt.datetime(2024, 1, 1)


def _skewed_rows(n=6000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        r = rng.random()
        if r < 0.3:
            s, d = "hot", "target"                         # hot pair
        elif r < 0.4:
            s, d = "hot", f"h{rng.randrange(60)}"          # hot host, other targets
        else:
            s, d = f"h{rng.randrange(60)}", f"h{rng.randrange(60)}"
        ts = T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 5))
        rows.append((i, s, d, ts, float(rng.randint(1, 500)), "BENIGN" if rng.random() < 0.7 else "X"))
    return rows


def _df(spark, rows):
    return spark.createDataFrame(rows, "row_id long, src string, dst string, ts timestamp_ntz, bytes double, label string")


def test_skewed_edges_and_volumes_match_pandas(spark):
    rows = _skewed_rows()
    pdf = pd.DataFrame(rows, columns=["row_id", "src", "dst", "ts", "bytes", "label"])
    pdf["bucket"] = pdf["ts"].dt.floor("h")
    want = pdf.groupby("bucket").size().sum()
    hb = FT.host_bucket_stats(E.build_edges(_df(spark, rows), "1 hour"))
    got = hb.agg(F.sum("flow_volume")).first()[0]
    assert got == want == len(rows)
    hot = (pdf[pdf.src == "hot"].groupby("bucket").size()).sort_index()
    got_hot = {r.bucket: r.flow_volume for r in hb.where("host = 'hot'").collect()}
    assert {k.to_pydatetime(): v for k, v in hot.items()} == got_hot


def test_skewed_novelty_matches_pandas(spark):
    rows = _skewed_rows()
    pdf = pd.DataFrame(rows, columns=["row_id", "src", "dst", "ts", "bytes", "label"])
    first = pdf.sort_values(["ts", "row_id"]).drop_duplicates(["src", "dst"])["row_id"]
    got = {r.row_id for r in flow_novelty(_df(spark, rows)).where("novel_dst_for_src").collect()}
    assert got == set(first)


def test_skewed_chain_counts_match_pandas(spark):
    rows = _skewed_rows()
    pdf = pd.DataFrame(rows, columns=["row_id", "src", "dst", "ts", "bytes", "label"]).sort_values(["ts", "row_id"])
    t0 = T0 + dt.timedelta(days=2)
    host = pdf[pdf.src == "hot"]
    prior = set(host[host.ts < t0].dst)
    seen, cum = set(prior), []
    for d in host[host.ts >= t0].dst:
        seen.add(d)
        cum.append(len(seen))
    tl = CH.post_compromise_timeline(_df(spark, rows), "hot", t0, chunks=6).orderBy("ts", "row_id")
    assert [r.cumulative_distinct_destinations for r in tl.collect()] == cum


def test_skewed_sample_is_exact_per_label(spark):
    rows = _skewed_rows()
    s = stratified_sample(_df(spark, rows), "label", 700)
    got = {r.label: r.n for r in s.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_x = sum(1 for r in rows if r[5] == "X")
    assert got == {"BENIGN": 700, "X": min(700, n_x)}
