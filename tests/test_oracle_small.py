"""The correctness gate inside the test suite: fast registered queries against their DuckDB
oracle SQL on the smallest table set."""
import importlib
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
FAST = ["edges_hourly", "graph_summary", "fan_degree", "out_volume", "novelty_score", "zscores",
        "degree_ratio_change", "running_stats", "top_volume_z", "clustering", "profile_totals",
        "label_distribution", "drop_blank_rows", "coerce_inf", "parse_ambiguous_ts", "bucket_5min",
        "split_stratified", "split_group", "stratified_sample", "loco_folds", "classification_report",
        "flow_novelty", "chain_timeline", "pivot_summary", "mttd", "hosts_reached", "enrich_guard",
        "unseen_classes", "label_index", "lineitem_host_features", "pagerank", "stream_flow_novelty"]


@pytest.fixture(scope="module")
def duck():
    oc = importlib.import_module("oracle_check")
    return oc, oc.duck_views(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    oc, con = duck
    ent = importlib.import_module("__spark_entry__")
    ok, msg = oc.compare(spark, con, name, ent.queries()[name], ent.oracle_sql()[name], SF)
    assert ok, msg


def test_impute_median_all_covers_every_imputed_column(spark, duck):
    """All 26 columns, the z-scores and pagerank too, against DuckDB."""
    from hostgraph.plans import sqlparts as S
    _, con = duck
    feats = ["fan_out", "fan_in", "pagerank", "degree_ratio_change", "novelty_score", "flow_volume", "byte_volume",
             "fan_out_zscore", "fan_in_zscore", "novelty_zscore", "flow_volume_zscore", "byte_volume_zscore"]
    cols = {"bytes": "fl.bytes", "dst_port": "fl.dst_port"}
    cols |= {f"{end}_{f}": f"{end[0]}{'p' if f == 'pagerank' else ''}.{f}" for end in ("src", "dst") for f in feats}
    sql = S.with_(S.FLOWS, S.edges("1 day"), S.HOST_BUCKET, S.BASELINES, S.pagerank_ctes()) + f"""
, ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || row_id), row_id) AS r, count(*) OVER () AS k
             FROM flows WHERE label = 'BENIGN'),
t AS MATERIALIZED (SELECT {", ".join(f"{v} AS {c}" for c, v in cols.items())} FROM ranked fl
  {" ".join(f"LEFT JOIN {t} {a} ON {a}.bucket = date_trunc('day', fl.ts) AND {a}.host = fl.{e}"
            for t, a, e in (("hf", "s", "src"), ("hf", "d", "dst"), ("pr", "sp", "src"), ("pr", "dp", "dst")))}
  WHERE fl.r > round_even(fl.k * 0.2, 0))
""" + " UNION ALL ".join(f"SELECT '{c}', quantile_cont(CAST({c} AS DOUBLE), 0.5), count(*) - count({c}) FROM t" for c in cols)
    want = {c: (m, n) for c, m, n in con.execute(sql).fetchall()}
    got = {r.feature: (r.median, r.n_missing) for r in
           importlib.import_module("__spark_entry__").queries()["impute_median_all"](spark, SF).collect()}
    assert set(got) == set(want) and len(got) == 26
    for c, (median, missing) in want.items():
        assert got[c][1] == missing, c
        assert got[c][0] == pytest.approx(median, abs=2e-6), c
