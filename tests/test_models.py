import numpy as np
from pyspark.sql import functions as F

from hostgraph.operators import iforest as IF
from hostgraph.operators import models as ML


def test_feature_columns_exclusion_and_graph_prefix(spark):
    df = spark.createDataFrame([(1, 2.0, 3, 0.1, 0.2, "x")],
                               "row_id long, bytes double, dst_port int, src_fan_out double, "
                               "src_clustering_coefficient double, label string")
    assert ML.feature_columns(df, True) == ["bytes", "dst_port", "src_fan_out"]
    assert ML.feature_columns(df, False) == ["bytes", "dst_port"]


def test_gbt_pipeline_learns_a_threshold(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 400)
    rows = [(int(i), float(v) if i % 9 else None, int(v > 5)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, bytes double, y int")
    model = ML.gbt_pipeline(["bytes"], max_iter=5).fit(df)
    s = ML.score(model, df).where(F.col("bytes").isNotNull())
    acc = s.agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.95


def test_mean_gain_counts_every_split(spark):
    from hostgraph.operators.attribution import load_tree_nodes
    from hostgraph.session import scratch_path
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), int(a + 0.3 * b > 5)) for i, (a, b) in enumerate(rng.uniform(0, 10, (300, 2)))]
    df = spark.createDataFrame(rows, "row_id long, bytes double, src_fan_out double, y int")
    model = ML.gbt_pipeline(["bytes", "src_fan_out"], max_iter=4, max_depth=3).fit(df)
    ML.save_model(model, path := scratch_path(spark, "gain"))
    got = {r.feature: r for r in ML.mean_gain(spark, model, path, ["bytes", "src_fan_out"]).collect()}
    nodes = load_tree_nodes(spark, path, model)
    inner = nodes[nodes["left"] >= 0]
    assert {f: r.n_splits for f, r in got.items()} == {
        ["bytes", "src_fan_out"][int(f)]: int(n) for f, n in inner.groupby("feature").size().items()}
    assert got["src_fan_out"].is_graph_feature and not got["bytes"].is_graph_feature
    assert all(r.mean_gain > 0 for r in got.values())


def test_isolation_forest_builds_every_tree(spark):
    """More trees than disjoint samples would fill, each on its own full sample."""
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (600, 2)))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    forest = IF.fit(df, ["a", "b"], n_trees=40, sample_size=64)
    roots = forest[forest["depth"] == 0]
    assert sorted(roots["tree"]) == list(range(40)) and set(roots["size"]) == {64}
    assert roots["threshold"].nunique() > 30             # the samples differ
    test = spark.createDataFrame([(10000, 0.0, 0.0), (10001, 8.0, 8.0)], "row_id long, a double, b double")
    got = {r.row_id: r.anomaly_score for r in IF.score(test, forest, ["a", "b"]).collect()}
    assert got[10001] > 0.5 > got[10000]
    small = IF.fit(df.limit(30), ["a", "b"], n_trees=5, sample_size=64)
    assert set(small.loc[small["depth"] == 0, "size"]) == {30}


def test_protocol_rounds():
    """The registered runs use the rounds and depths of the protocols."""
    import inspect
    gbt = inspect.signature(ML.gbt_pipeline).parameters
    assert (gbt["max_iter"].default, gbt["max_depth"].default, gbt["step_size"].default) == (200, 6, 0.1)
    assert (ML.MULTI_ROUNDS, ML.MULTI_DEPTH, ML.LEARNING_RATE) == (300, 8, 0.1)
    assert inspect.signature(ML.zero_day_rates).parameters["max_iter"].default == 150
    assert inspect.signature(IF.fit).parameters["n_trees"].default == 200


def test_zero_day_counts_rows_without_a_label(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), "BENIGN" if x < 5 else "a" if x < 8 else None, int(x >= 5)) for i, x in enumerate(rng.uniform(0, 10, 300))]
    df = spark.createDataFrame(rows, "row_id long, bytes double, label string, y int")
    got = ML.zero_day_rates(df, df.where("label = 'BENIGN'").limit(20), ["bytes"], ["a", None], max_iter=4)
    assert [r["class"] for r in got] == ["a", None]
    assert [r["support"] for r in got] == [sum(r[2] == "a" for r in rows), sum(r[2] is None for r in rows)]
    assert got[1]["zero_day_catch_rate"] == 1.0 and got[0]["benign_fpr"] == 0.0


def test_c_factor_known_values():
    assert IF.c_factor([2])[0] == 1.0
    assert abs(IF.c_factor([256])[0] - 10.244770920116851) < 1e-9


def test_require_columns_schema_only(spark):
    import pytest
    df = spark.createDataFrame([(1.0,)], "a double")
    ML.require_columns(df, ["a"])
    with pytest.raises(ValueError):
        ML.require_columns(df, ["a", "b"])


def test_scale_conf_sizes_partitions_from_input():
    from hostgraph.session import scale_conf
    c = scale_conf(100 * 1024 ** 4)                      # 100 TB
    assert int(c["spark.sql.shuffle.partitions"]) == 409_600
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = scale_conf(10 * 1024 ** 2, executors_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24


def _wide(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 10, (n, 3))
    rows = [(i, ["BENIGN", "scan", "error"][i % 3], float(a) if i % 7 else None, float(b), float(c), int(a > 5))
            for i, (a, b, c) in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, label string, bytes double, src_fan_out double, dst_fan_in double, y int")


COLS = ["bytes", "src_fan_out", "dst_fan_in"]


def test_fit_reads_its_rows_twice_and_grows_the_pipelines_trees(spark):
    """Once for the medians, once for the vectors that the learner then reads again and again."""
    df = _wide(spark).coalesce(2)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    model = ML.fit_gbt(df.mapInArrow(counted, df.schema), COLS, max_iter=4, max_depth=3)
    assert read.value <= 2 * df.count()
    whole = ML.gbt_pipeline(COLS, max_iter=4, max_depth=3).fit(df)
    a, b = (m.stages[-1].toDebugString.split("\n", 1)[1] for m in (model, whole))
    assert a == b and len(a) > 100
    assert model.stages[0].surrogateDF.collect() == whole.stages[0].surrogateDF.collect()


def test_methods_too_long_for_the_jvm_are_not_generated(spark):
    """Inside, stages whose method the JVM would interpret are run operator by operator; the setting comes back."""
    import pytest
    from hostgraph.session import HUGE_METHOD, compilable_methods
    before = spark.conf.get(HUGE_METHOD)
    assert int(before) > 8000
    with pytest.raises(ValueError), compilable_methods(spark):
        assert int(spark.conf.get(HUGE_METHOD)) == 8000
        with compilable_methods(spark):
            pass
        assert int(spark.conf.get(HUGE_METHOD)) == 8000
        raise ValueError
    assert spark.conf.get(HUGE_METHOD) == before


def _model_stages(spark, monkeypatch):
    """A small model and its flows in place of the stages'."""
    from hostgraph.plans import stages as ST
    from hostgraph.session import scratch_path
    flows = _wide(spark).selectExpr("*", "if(row_id % 2 = 0, 'train', 'test') AS side",
                                    "if(row_id % 2 = 0, 'Monday', 'Friday') AS day").cache()
    model = ML.fit_gbt(flows.where("side = 'train'"), COLS, max_iter=3, max_depth=3)
    ML.save_model(model, path := scratch_path(spark, "small-model"))
    monkeypatch.setattr(ST, "labelled", lambda *a: flows)
    monkeypatch.setattr(ST, "day_labelled", lambda *a: flows)
    monkeypatch.setattr(ST, "day_split_model", lambda *a: ML.load_model(path))
    monkeypatch.setattr(ST, "model_path", lambda *a: path)
    written = {}

    def cached(spark, sf, name, build):
        if name not in written:
            written[name] = scratch_path(spark, name)
            build().write.parquet(written[name])
        return spark.read.parquet(written[name])

    monkeypatch.setattr(ST, "cached", cached)
    return flows, model


def test_flows_are_scored_once_for_all_queries(spark, monkeypatch):
    from hostgraph.plans import q_models as Q
    flows, model = _model_stages(spark, monkeypatch)
    calls, score = [], ML.score
    monkeypatch.setattr(ML, "score", lambda *a, **k: calls.append(a) or score(*a, **k))
    got = {r.row_id: (r.y, r.pred, r.attack_probability) for r in Q.q_score_flows(spark, "").collect()}
    rule = Q.q_score_rule(spark, "").collect()
    assert len(calls) == 1 and len(rule) == flows.count() and all(r.class_is_likelier for r in rule)
    want = score(model, ML.as_float(flows, COLS)).collect()
    assert got == {r.row_id: (r.y, r.pred, round(r.attack_probability, 6)) for r in want}
    equal = Q.q_model_roundtrip(spark, "").collect()
    assert len(calls) == 2 and len(equal) == flows.count() and all(r.equal for r in equal)
    f1 = Q.q_gbt_binary(spark, "").first()
    assert f1.tp + f1.fp + f1.fn + f1.tn == flows.where("side = 'test'").count()


def test_every_row_of_the_sample_is_explained_once(spark, monkeypatch):
    from hostgraph.operators import attribution as AT
    from hostgraph.plans import q_models as Q
    flows, _ = _model_stages(spark, monkeypatch)
    explained, explain = spark.sparkContext.accumulator(0), AT.explain

    def counted(batches):
        for b in batches:
            explained.add(b.num_rows)
            yield b

    def explain_counted(*a, **k):
        e = explain(*a, **k)
        return e.mapInArrow(counted, e.schema)

    monkeypatch.setattr(AT, "explain", explain_counted)
    r = Q.q_attribution_check(spark, "").first()
    assert r.n_rows == flows.where("side = 'test'").count() and r.locally_accurate
    assert explained.value == r.n_rows


def test_attribution_share_takes_every_test_row(spark, monkeypatch):
    """More than 500 rows of a label, ids that repeat or are NULL: all of them count, each once."""
    from hostgraph.operators import attribution as AT
    from hostgraph.plans import q_models as Q
    from hostgraph.plans import stages as ST
    flows, model = _model_stages(spark, monkeypatch)
    path = ST.model_path(spark, "")
    many = 520 // flows.where("side = 'test'").count() + 1
    flows = flows.withColumn("row_id", F.expr("nullif(row_id, 3)")).withColumn(
        "label", F.expr("if(row_id % 4 = 1, 'x', 'BENIGN')")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4 * many)))).drop("copy")
    monkeypatch.setattr(ST, "day_labelled", lambda *a: flows)
    test = ML.as_float(flows.where("side = 'test'"), COLS)
    got = {r.label: r for r in Q.q_attribution_share(spark, "").collect()}
    imputed = model.stages[0].transform(test).select("label", *[F.col(c).cast("double") for c in model.stages[0].getOutputCols()]).toPandas()
    leaves, _ = AT.leaf_paths(AT.load_tree_nodes(spark, path, model), list(model.stages[-1].treeWeights))
    total = np.abs(AT.shap_values(imputed.iloc[:, 1:].to_numpy(), leaves, len(COLS))).sum(1)
    assert max(r.n for r in got.values()) > 500
    for label, rows in imputed.groupby("label").groups.items():
        assert got[label].n == len(rows)
        assert abs(got[label].mean_total_abs_phi - total[rows].mean()) < 1e-6
