import math

import numpy as np

from hostgraph.llm import lattice


def test_closest_point_of_e8():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) * 2
    got = lattice.closest_e8(x)
    twice = np.rint(2 * got).astype(int)
    assert np.allclose(2 * got, twice)
    assert all(len({v % 2 for v in row}) == 1 for row in twice)      # all integers or all halves
    assert (got.sum(1) % 2 == 0).all()
    # no neighbour is closer, and the covering radius of E8 is 1
    roots = lattice.minimal_vectors()
    assert len(roots) == 240 and np.allclose((roots ** 2).sum(1), 2)
    near = ((x - got) ** 2).sum(1)
    for r in roots:
        assert (near <= ((x - got - r) ** 2).sum(1) + 1e-9).all()
    assert near.max() <= 1 + 1e-9


def brute(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    vec = {}
    for d, v in rows:
        if d is not None:
            ok = v and all(c is not None and math.isfinite(c) for c in v) and any(v)
            vec[d] = np.array(v, float) if ok else None
    link = {d: [] for d in ids}
    for a in ids:
        for b in ids:
            x, y = vec[a], vec[b]
            if a != b and x is not None and y is not None and len(x) == len(y):
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.95:
                    link[a].append(b)
    comp = {}
    for d in ids:
        seen, todo = {d}, [d]
        while todo:
            for e in link[todo.pop()]:
                if e not in seen:
                    seen.add(e)
                    todo.append(e)
        comp[d] = min(seen)
    return {d: (len(link[d]), comp[d], comp[d] == d) for d in ids}


def rows(rng):
    out, n = [], 0
    for _ in range(60):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 6)):
            out.append((n, (base + rng.normal(size=24) * 0.1).astype(np.float32).tolist()))
            n += 1
    hot = rng.normal(size=24)
    for _ in range(90):                      # one large group of near copies, and one of copies
        out.append((n, (hot + rng.normal(size=24) * 0.12).astype(np.float32).tolist()))
        n += 1
    same = rng.normal(size=24).astype(np.float32).tolist()
    out += [(n + i, same) for i in range(25)]
    n += 25
    out += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [1.0, None] + [0.0] * 22),
            (n + 5, [float("inf")] + [1.0] * 23), (n + 6, [1.0, 0.0]), (n + 7, [2.0, 0.01]), (3, out[3][1]), (None, same)]
    return out


def test_against_brute_force(spark):
    data = rows(np.random.default_rng(4))
    df = spark.createDataFrame([(d, v, 1, "c") for d, v in data], "vec_id long, embedding array<float>, node int, cells string")
    got = lattice.near_vectors(df.repartition(4), chunk=16).collect()
    assert sum(r.vec_id is None for r in got) == 1
    assert all(r.n_links == 0 and r.component_id is None and not r.kept for r in got if r.vec_id is None)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert got == brute(data)


def test_recall_at_the_threshold():
    """Pairs of cosine 0.95 to 0.96, the hardest: the share that meets in some cell."""
    rng = np.random.default_rng(2)
    n, dim = 2000, 64
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(n, dim))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.95, 0.96, size=(n, 1))
    b = cos * a + np.sqrt(1 - cos ** 2) * side
    args = (lattice.TABLES, lattice.BLOCKS, lattice.PROBES, lattice.WIDTH, lattice.SEED)
    x, y = lattice.cells(a, *args), lattice.cells(b, *args)
    met = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3))
    assert met.mean() > 0.99


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice.near_vectors(df).count() == 0
