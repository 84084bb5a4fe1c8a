import datetime as dt
import random

import numpy as np
import pytest

from hostgraph.operators.clustering import clustering_coefficient
from hostgraph.operators.pagerank import pagerank

B0, B1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
SCHEMA = "bucket timestamp_ntz, src string, dst string, flow_count long, total_bytes double"


def _random_edges(seed, n_nodes=9, n_edges=25):
    rng = random.Random(seed)
    pairs = set()
    while len(pairs) < n_edges:
        pairs.add((f"n{rng.randrange(n_nodes)}", f"n{rng.randrange(n_nodes)}"))
    return [(s, d, rng.randint(1, 5)) for s, d in sorted(pairs)]


def _numpy_pagerank(edges, alpha=0.85, tol=1e-6, max_iter=100):
    nodes = sorted({x for s, d, _ in edges for x in (s, d)})
    ix = {n: i for i, n in enumerate(nodes)}
    N = len(nodes)
    W = np.zeros((N, N))
    for s, d, w in edges:
        W[ix[s], ix[d]] += w
    out = W.sum(axis=1)
    A = np.divide(W, out[:, None], out=np.zeros_like(W), where=out[:, None] > 0)
    dangling = out == 0
    x = np.full(N, 1.0 / N)
    for _ in range(max_iter):
        last = x
        x = alpha * (x @ A + last[dangling].sum() / N) + (1 - alpha) / N
        if np.abs(x - last).sum() < N * tol:
            break
    return dict(zip(nodes, x))


@pytest.mark.parametrize("task_edges,steps", [(100, 10), (0, 4), (15, 4)])
def test_pagerank_matches_power_iteration_and_sums_to_one(spark, task_edges, steps):
    g0, g1 = _random_edges(1), _random_edges(2, 6, 10)
    rows = [(B0, s, d, w, 0.0) for s, d, w in g0] + [(B1, s, d, w, 0.0) for s, d, w in g1]
    pr = pagerank(spark.createDataFrame(rows, SCHEMA), task_edges=task_edges, steps=steps).collect()
    for b, g in ((B0, g0), (B1, g1)):
        want = _numpy_pagerank(g)
        got = {r.host: r.pagerank for r in pr if r.bucket == b}
        assert set(got) == set(want)
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-12)
        assert sum(got.values()) == pytest.approx(1.0, abs=1e-9)


def test_pagerank_with_split_sources_and_no_convergence(spark, monkeypatch):
    from hostgraph.operators import pagerank as PR
    monkeypatch.setattr(PR, "PART_EDGES", 2)
    g = _random_edges(7, 9, 30) + [("hub", f"n{i}", 1) for i in range(9)]
    df = spark.createDataFrame([(B0, s, d, w, 0.0) for s, d, w in g], SCHEMA)
    got = {r.host: r.pagerank for r in pagerank(df, task_edges=0).collect()}
    want = _numpy_pagerank(g)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    for task_edges in (0, 1000):
        with pytest.raises(RuntimeError, match="2024-01-01"):
            pagerank(df, max_iter=2, task_edges=task_edges)
    assert pagerank(df.limit(0)).collect() == []


def _numpy_clustering(edges):
    nodes = sorted({x for s, d, _ in edges for x in (s, d)})
    ix = {n: i for i, n in enumerate(nodes)}
    A = np.zeros((len(nodes), len(nodes)))
    for s, d, _ in edges:
        if s != d:
            A[ix[s], ix[d]] = 1
    S = A + A.T
    t = np.diag(S @ S @ S)
    dtot = S.sum(axis=1)
    dbi = np.diag(A @ A)
    denom = 2 * (dtot * (dtot - 1) - 2 * dbi)
    c = np.divide(t, denom, out=np.zeros_like(t), where=denom > 0)
    return dict(zip(nodes, c))


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_clustering_matches_matrix_form(spark, seed, monkeypatch):
    from hostgraph.operators import clustering as CLU
    monkeypatch.setattr(CLU, "PART_PAIRS", 1 if seed == 4 else 1000)       # with and without parts
    g = _random_edges(seed, 8, 24) + [("n1", "n1", 1)]
    cc = clustering_coefficient(spark.createDataFrame([(B0, s, d, w, 0.0) for s, d, w in set(g)], SCHEMA))
    got = {r.host: r.clustering_coefficient for r in cc.collect()}
    want = _numpy_clustering(set(g))
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_clustering_triangle_and_isolated_pair(spark):
    rows = [(B0, "a", "b", 1, 0.0), (B0, "b", "c", 1, 0.0), (B0, "c", "a", 1, 0.0), (B0, "x", "y", 1, 0.0)]
    got = {r.host: r.clustering_coefficient for r in clustering_coefficient(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a"] == pytest.approx(0.5) and got["x"] == 0.0
