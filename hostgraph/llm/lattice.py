"""Near-duplicate vectors by E8 lattice hashing.

A table projects a unit vector by random Gaussian rows onto blocks of eight dimensions; each block
is decoded to the closest point of the E8 lattice, and the points of the blocks together name a
cell.  A vector enters its own cell and the cells reached by the minimal vectors of E8 that bring a
block's point closest to the projection (probes).  Vectors that share a cell in any table are
compared by cosine in double precision.

Equal vectors are one node with a multiplicity.  A cell with more members than ``chunk`` is cut
into chunks, and each pair of chunks is one unit of work of bounded size (two chunks of vectors);
links are counted there and leave as one partial count per vector and a spanning forest, never as
pairs.  A pair that meets in several cells counts where it meets first.
"""
from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import drop_table, write_table

COSINE = 0.95
TABLES, BLOCKS, PROBES, WIDTH = 12, 2, 6, 1.5
SEED = 7


def _closest_d8(x: np.ndarray) -> np.ndarray:
    """Closest points with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    at = np.arange(len(x))
    step = np.where(off[at, worst] >= 0, 1.0, -1.0)
    odd = near.sum(1) % 2 != 0
    near[at[odd], worst[odd]] += step[odd]
    return near


def closest_e8(x: np.ndarray) -> np.ndarray:
    """Closest points of E8 = D8 and D8 shifted by one half, for rows of ``x`` (n x 8)."""
    whole = _closest_d8(x)
    half = _closest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(1)
def minimal_vectors() -> np.ndarray:
    """The 240 vectors of squared length 2."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


@lru_cache(8)
def _projections(dim: int, tables: int, blocks: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((tables, blocks, dim, 8))


@lru_cache(8)
def _keys(blocks: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, 1]).integers(1, 1 << 62, (blocks, 8), dtype=np.int64) | 1


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int, width: float, seed: int) -> np.ndarray:
    """Cell keys (int64, vectors x tables x (1 + probes)); the first is the vector's own cell."""
    n, dim = unit.shape
    roots, keys = minimal_vectors(), _keys(blocks, seed)
    moved = 2 * roots.astype(np.float64)
    out = np.empty((n, tables, 1 + probes), np.int64)
    with np.errstate(over="ignore"):
        shift = [(moved.astype(np.int64) * keys[b]).sum(1) for b in range(blocks)]
        for t in range(tables):
            own = np.full(n, t * 0x632BE59BD9B4E019 & 0x7FFFFFFFFFFFFFFF, np.int64)
            gain, step = [], []
            for b in range(blocks):
                x = unit @ _projections(dim, tables, blocks, seed)[t, b] / width
                point = closest_e8(x)
                own += ((2 * point).astype(np.int64) * keys[b]).sum(1)
                gain.append((x - point) @ roots.T)       # the larger, the closer the neighbour
                step.append(shift[b])
            gain, step = np.concatenate(gain, 1), np.concatenate(step)
            best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.empty((n, 0), int)
            out[:, t, 0] = own
            out[:, t, 1:] = own[:, None] + step[best]
    return out


def _unit(batch: pa.RecordBatch, column: str) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(batch.num_rows, -1)
    m = m / np.abs(m).max(1, keepdims=True)          # no overflow of squares
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links a-b."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def near_vectors(vectors: DataFrame, threshold: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS,
                 probes: int = PROBES, width: float = WIDTH, chunk: int = 1024, seed: int = SEED,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Null, empty and zero vectors and those with null or non-finite components link with nothing,
    nor do vectors of different length with each other.  Rows that repeat id and vector count
    once; a null id gives ``n_links`` 0, a null component and ``kept`` false; an empty table gives
    no rows.  Other columns (labels too) are not read."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                       F.col(vec_col).cast("array<double>").alias("x")).distinct()
    sound = (F.col("vec_id").isNotNull() & F.col("x").isNotNull()
             & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
             & F.exists("x", lambda c: c != 0))
    # equal vectors: one node, named by the smallest id
    nodes, node_path = write_table(v.where(sound).groupBy("x").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors")

    def hashed(batches):
        for batch in batches:
            sizes = np.diff(batch.column("x").offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                for i in range(0, part.num_rows, 2048):
                    some = part.slice(i, 2048)
                    c = cells(_unit(some, "x"), tables, blocks, probes, width, seed)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("node"), pa.array(list(c.reshape(len(c), -1)), pa.list_(pa.int64()))],
                        names=["node", "cells"])

    coded, coded_path = write_table(
        nodes.select("node", "x").mapInArrow(hashed, "node long, cells array<long>"), "cells")
    entered = coded.select("node", F.posexplode("cells").alias("at", "cell")).select(
        "node", (F.col("at") / (1 + probes)).cast("int").alias("tab"), "cell").distinct()
    size = (entered.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select("tab", "cell", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    # member of chunk c: in the work of the chunk pairs (c, k) and (k, c)
    work = (entered.join(size, ["tab", "cell"])
            .withColumn("c", F.pmod(F.xxhash64("node", "tab"), F.col("chunks")).cast("int"))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("tab", "cell", F.least("c", "k").alias("i"), F.greatest("c", "k").alias("j"), "c", "node"))
    payload = nodes.join(coded, "node").select("node", "x", "cells", "copies")
    rows = (work.join(payload, "node").repartition("tab", "cell", "i", "j")
            .sortWithinPartitions("tab", "cell", "i", "j", "node"))

    def met_before(a: np.ndarray, b: np.ndarray, tab: int, cell: int) -> np.ndarray:
        """Which of the pairs (cells of a, cells of b) share a cell of an earlier table, or a
        smaller one of this table."""
        seen = np.zeros(len(a), bool)
        for t in range(tab + 1):
            left = np.flatnonzero(~seen)
            if not len(left):
                break
            same = a[left, t][:, :, None] == b[left, t][:, None, :]
            if t == tab:
                same &= (a[left, t] < cell)[:, :, None]
            seen[left] = same.any((1, 2))
        return seen

    def compare(keys: tuple, parts: list[pa.RecordBatch]):
        """Partial link counts of the nodes of one unit of work, and a forest of its links."""
        got = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        tab, cell, i, j = keys
        sizes = np.diff(got.column("x").offsets.to_numpy())
        node, c, copies = (got.column(k).to_numpy() for k in ("node", "c", "copies"))
        code = np.stack(got.column("cells").to_numpy(zero_copy_only=False)).reshape(len(node), tables, 1 + probes)
        counts, edges = np.zeros(len(node), np.int64), []
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            unit = _unit(got.filter(pa.array(sizes == dim)), "x")
            for lo in range(0, len(own), 512):
                near = unit[lo:lo + 512] @ unit.T >= threshold
                a, b = np.nonzero(near)
                a, b = own[a + lo], own[b]
                pair = (node[a] < node[b]) & ((c[a] != c[b]) | (i == j))
                a, b = a[pair], b[pair]
                for s in range(0, len(a), 16_384):
                    x, y = a[s:s + 16_384], b[s:s + 16_384]
                    new = ~met_before(code[x], code[y], tab, cell)
                    x, y = x[new], y[new]
                    np.add.at(counts, x, copies[y])
                    np.add.at(counts, y, copies[x])
                    edges += _forest(node[x], node[y])
        linked = np.flatnonzero(counts)
        if len(edges):
            edges = _forest(*np.array(edges, np.int64).T)
        u = np.concatenate([node[linked], np.array([e[0] for e in edges], np.int64)])
        w = [None] * len(linked) + [e[1] for e in edges]
        n = np.concatenate([counts[linked], np.zeros(len(edges), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(n, pa.int64())],
                                          names=["u", "v", "n"])

    def verify(batches):
        now, parts = None, []
        for batch in batches:
            key = [batch.column(k).to_numpy() for k in ("tab", "cell", "i", "j")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                group = tuple(int(k[lo]) for k in key)
                if group != now and parts:
                    if (out := compare(now, parts)).num_rows:
                        yield out
                    parts = []
                now = group
                parts.append(batch.slice(lo, hi - lo))
        if parts and (out := compare(now, parts)).num_rows:
            yield out

    found, found_path = write_table(rows.mapInArrow(verify, "u long, v long, n long"), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    linked, linked_path = components(found.where("v IS NOT NULL").select("u", "v"))
    # back to every vector: a copy also links with the other copies
    named = (nodes.join(counts, "node", "left").join(linked, "node", "left")
             .select("x", F.coalesce("component", "node").alias("component_id"),
                     (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.lit(True).alias("sound")))
    out, _ = write_table(
        v.join(named, "x", "left")
        .select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0)
                .cast("long").alias("n_links"),
                F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "vector-classes")
    for p in (node_path, coded_path, found_path, linked_path):
        drop_table(spark, p)
    return out
