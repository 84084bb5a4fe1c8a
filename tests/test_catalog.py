import importlib


def test_every_query_has_survey_id_and_sql_keys_are_queries():
    ent = importlib.import_module("__spark_entry__")
    from hostgraph.plans.catalog import REGISTRY
    q, sql = ent.queries(), ent.oracle_sql()
    assert set(sql) <= set(q)
    assert set(REGISTRY) <= set(q) and all(e.survey_id for e in REGISTRY.values())
    assert len(q) >= 88


def test_entry_smoke(spark):
    ent = importlib.import_module("__spark_entry__")
    df = ent.entry(spark)
    rows = df.collect()
    assert df.columns == ["bucket", "host", "flow_volume", "flow_volume_zscore"]
    assert 0 < len(rows) <= 10
