"""Plan audit: no registered query may plan a cartesian product or a nested-loop join,
and flow-level scans must be column-pruned (no full-width read of the events table)."""
import importlib

import pytest

SF = "/root/testdata/sf0.001"
# every registered query but those that fit models (their joins are the stages', audited here too)
MODELS = {"gbt_binary", "score_flows", "multi_class", "feature_gain", "model_roundtrip", "zero_day", "isolation_forest",
          "pivot_check", "pivot_scores", "model_chain_timeline", "model_pivot_summary", "model_novel_summary",
          "model_chain_headline", "model_mttd", "detection_regimes", "attribution_rank", "attribution_share",
          "attribution_check", "f1_by_feature_set", "multi_class_margins", "score_rule", "feature_mean_gain"}


def _names():
    from hostgraph.plans.catalog import REGISTRY
    return sorted(set(REGISTRY) - MODELS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", _names())
def test_no_cartesian_or_nested_loop(spark, name):
    ent = importlib.import_module("__spark_entry__")
    df = ent.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()      # final adaptive plan
    plan = _plan(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_edge_scan_is_pruned(spark):
    ent = importlib.import_module("__spark_entry__")
    plan = _plan(ent.queries()["edges_hourly"](spark, SF))
    read = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "event_type" not in read and "event_id" not in read


def test_pagerank_has_no_window(spark):
    """Neither a bucket's nodes nor a source's edges meet in one window."""
    from hostgraph.operators import pagerank as PR
    e = spark.createDataFrame([("b", "s", "d", 1)], "bucket string, src string, dst string, flow_count long")
    nodes = PR.node_table(e, "flow_count")
    for df in (nodes, PR._arcs(e, nodes, "flow_count", ["bucket", "src"])):
        assert "Window" not in _plan(df)
