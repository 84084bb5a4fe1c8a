import itertools
import math

import numpy as np
import pandas as pd
import pytest

from hostgraph.operators.attribution import leaf_paths, shap_values


def _tree():
    # node table of one small tree over 3 features (ids as Spark writes them)
    rows = [
        (0, 0, 0.0, 100, 1, 2, 0, 0.5),
        (0, 1, 0.0, 60, 3, 4, 1, 0.3),
        (0, 2, 0.0, 40, 5, 6, 2, 0.7),
        (0, 3, 1.0, 20, -1, -1, -1, None),
        (0, 4, -2.0, 40, 7, 8, 0, 0.2),
        (0, 5, 3.0, 10, -1, -1, -1, None),
        (0, 6, 0.5, 30, -1, -1, -1, None),
        (0, 7, 4.0, 15, -1, -1, -1, None),
        (0, 8, -1.0, 25, -1, -1, -1, None),
    ]
    return pd.DataFrame(rows, columns=["treeID", "id", "value", "cover", "left", "right", "feature", "threshold"])


def _cond_expectation(t, x, S):
    """E[f(x) | x_S] with the cover-weighted (path-dependent) rule."""
    t = t.set_index("id")

    def ev(nid):
        n = t.loc[nid]
        if n["left"] < 0:
            return 2.0 * n["value"]          # the log-odds scale used by leaf_paths (weight 1)
        f = int(n["feature"])
        if f in S:
            return ev(int(n["left"]) if x[f] <= n["threshold"] else int(n["right"]))
        l, r = int(n["left"]), int(n["right"])
        return (t.loc[l, "cover"] * ev(l) + t.loc[r, "cover"] * ev(r)) / n["cover"]

    return ev(0)


@pytest.mark.parametrize("x", [[0.1, 0.1, 0.1], [0.9, 0.9, 0.9], [0.1, 0.5, 0.9], [0.6, 0.2, 0.6]])
def test_tree_shap_equals_brute_force_shapley(x):
    t = _tree()
    leaves, base = leaf_paths(t, [1.0])
    phi = shap_values(np.array([x]), leaves, 3)[0]
    M = 3
    for i in range(M):
        want = 0.0
        others = [j for j in range(M) if j != i]
        for k in range(M):
            for S in itertools.combinations(others, k):
                w = math.factorial(len(S)) * math.factorial(M - len(S) - 1) / math.factorial(M)
                want += w * (_cond_expectation(t, x, set(S) | {i}) - _cond_expectation(t, x, set(S)))
        assert phi[i] == pytest.approx(want, abs=1e-12)
    assert base == pytest.approx(_cond_expectation(t, x, set()))
    assert base + phi.sum() == pytest.approx(_cond_expectation(t, x, {0, 1, 2}))


def test_spark_gbt_attributions_sum_to_model_logit(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from hostgraph.operators import attribution as AT
    from hostgraph.operators import models as ML
    rng = np.random.default_rng(7)
    rows = [(int(i), float(a), float(b), float(c), int(a + 0.5 * b > 1.0))
            for i, (a, b, c) in enumerate(rng.uniform(0, 1.5, (300, 3)))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y int")
    cols = ["a", "b", "c"]
    model = ML.gbt_pipeline(cols, max_iter=6, max_depth=3).fit(df)
    path = str(tmp_path / "gbt")
    ML.save_model(model, path)
    ex = AT.explain(spark, model, path, df, cols, keep=("row_id", "y"))
    raw = model.transform(df).select("row_id", (2 * vector_to_array("rawPrediction")[1]).alias("lo"))
    err = ex.join(raw, "row_id").agg(F.max(F.abs(F.col("logit") - F.col("lo")))).first()[0]
    assert err < 1e-9
    # the unused feature gets no attribution
    phi_c = ex.select(F.max(F.abs(F.col("phi")[2]))).first()[0]
    used = set(AT.load_tree_nodes(spark, path, model)["feature"].tolist())
    if 2 not in used:
        assert phi_c == 0.0


@pytest.mark.parametrize("bits", [8, 2, 0])
def test_tables_give_what_the_leaves_give_row_by_row(monkeypatch, bits):
    """Leaves that share tables, whose tables are full, or that are worked out row by row: the same attributions."""
    from hostgraph.operators import attribution as AT
    t = _tree()
    two = pd.concat([t, t.assign(treeID=1, feature=t["feature"].where(t["feature"] < 0, 2 - t["feature"]))])
    leaves, base = leaf_paths(two, [1.0, 0.5])
    X = np.random.default_rng(5).uniform(0, 1, (200, 3))
    monkeypatch.setattr(AT, "TABLE_BITS", bits)
    monkeypatch.setattr(AT, "CHUNK_ROWS", 64)
    tables, others = AT.leaf_tables(leaves)
    assert (not tables) == (bits == 0) and bool(others) == (bits < 3)
    phi = AT.table_values(X, tables, others, 3)
    for x, got in zip(X, phi):
        want = [sum(shap_values(np.array([x]), [leaf], 3)[0][f] for leaf in leaves) for f in range(3)]
        assert got == pytest.approx(want, abs=1e-12)
        one = _cond_expectation(t, x, {0, 1, 2}) + 0.5 * _cond_expectation(two[two["treeID"] == 1], x, {0, 1, 2})
        assert base + got.sum() == pytest.approx(one)
