"""Weighted PageRank of every bucket's graph at once.

Semantics of the widely used power iteration: weight = ``flow_count``, out-weights
normalised per source (self-loops included), uniform start and teleport, the rank of
dangling nodes spread uniformly, damping 0.85, stop a graph when the L1 change of an
iteration falls below ``N * tol`` (at most ``max_iter`` iterations); the returned vector
is the one that met the tolerance.

Graphs of at most ``TASK_EDGES`` edges (counted first) are iterated whole, each by one task in NumPy
vectors: one exchange in all, and memory bounded by that number.  Larger ones are spread over the
cluster, as follows; no graph is left out or treated differently in its result.

Only the pushing along edges is iterated.  Teleport and dangling mass are, in every bucket, a
multiple s of the uniform vector u, so with A = alpha * P^T a step is x' = A x + s u, and ``i`` steps
from x are

    x_i = A^i x + s_(i-1) u + s_(i-2) A u + ... + s_0 A^(i-1) u,    s_j = alpha * dangling(x_j) + 1 - alpha.

A round pushes one vector ``steps`` times (the first round's vectors, from u, serve all rounds), and
then works out the numbers s from the dangling mass of the pushed vectors, all x_i of a node from its
own row, and the first one that met the tolerance from one aggregate.  Buckets that have it leave.

* One push is one exchange: contributions are partially summed per task, and the sums come out dealt
  as the next push needs them.  Edges are dealt and sorted once and kept; a node's earlier values travel
  along an edge to itself, so no second join is needed.
* A source with more than ``PART_EDGES`` edges in a bucket is split in parts by a hash of its
  destinations; its one value is copied to its parts (only then is there an exchange more).
* Out-weights and node counts are aggregates joined back, never windows, so neither a bucket nor a
  scanning host is one task's rows; tables of one row per bucket are joined by AQE from their size.
* A round's vectors are written once, so plans don't grow and a lost executor works out at most one
  round again.  All but the ranks are deleted.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path

TASK_EDGES = 1_000_000  # edges of a graph that one task iterates (about 100 bytes each)
PART_EDGES = 100_000    # edges of one source in one bucket that stay together
ALPHA = 0.85
TOL = 1.0e-6
MAX_ITER = 100
STEPS = 10              # pushes of a round


def node_table(edges: DataFrame, weight: str) -> DataFrame:
    """``bucket, host, w`` (out-weight; NULL: dangling), ``parts`` and ``n`` (nodes of the bucket)."""
    ends = edges.select("bucket", F.explode(F.array(
        F.struct(F.col("src").alias("host"), F.col(weight).cast("double").alias("w")),
        F.struct(F.col("dst").alias("host"), F.lit(None).cast("double").alias("w")))).alias("e"))
    nodes = ends.groupBy("bucket", F.col("e.host").alias("host")).agg(
        F.sum("e.w").alias("w"), F.greatest(F.lit(1), F.ceil(F.count("e.w") / PART_EDGES)).cast("int").alias("parts"))
    n = nodes.groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return nodes.join(n, "bucket")


def _arcs(edges: DataFrame, nodes: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    """The edges with their share ``p`` of the source's weight, and one arc of no share from each node to
    itself; dealt and sorted by the key of a push."""
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = edges.join(nodes.select("bucket", F.col("host").alias("src"), "w", "parts"), ["bucket", "src"]).select(
        "bucket", "src", "dst", (F.col(weight) / F.col("w")).alias("p"),
        F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"))
    own = nodes.select("bucket", F.col("host").alias("src"), F.col("host").alias("dst"),
                       F.lit(None).cast("double").alias("p"), F.lit(0).alias("part"))
    return out.unionByName(own).repartition(width, *keys).sortWithinPartitions(*keys)


def _push(state: DataFrame, arcs: DataFrame, keys: list[str], carried: list[str], i: int, alpha: float) -> DataFrame:
    """``c{i+1}`` = what arrives of ``c{i}``; the carried columns stay."""
    state = state.withColumnRenamed("host", "src")
    if "part" in keys:
        state = state.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    own = F.col("p").isNull()
    return (arcs.join(state.hint("merge"), keys).groupBy("bucket", F.col("dst").alias("host")).agg(
        *[F.sum(F.when(own, F.col(c))).alias(c) for c in carried],
        F.coalesce(F.sum(F.lit(alpha) * F.col("p") * F.col(f"c{i}")), F.lit(0.0)).alias(f"c{i + 1}")))


def _scalars(vectors: DataFrame, steps: int, alpha: float) -> DataFrame:
    """Per bucket the multiples ``s0..`` of the uniform vector that the steps add."""
    mass = lambda v: F.array(*[F.sum(F.col("dangling") * F.col(f"{v}{j}")) for j in range(steps)])
    sums = vectors.groupBy("bucket").agg(mass("c").alias("c"), mass("y").alias("y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    s = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.expr("CAST(array() AS array<double>)"),
                    lambda known, j: F.concat(known, F.array(
                        F.lit(alpha) * (F.get(F.col("c"), j) + dot(F.reverse(known), F.slice(F.col("y"), F.lit(1), j)))
                        + F.lit(1.0 - alpha))))
    return sums.select("bucket", s.alias("s")).select("bucket", *[F.get("s", F.lit(j)).alias(f"s{j}") for j in range(steps)])


def _iterates(vectors: DataFrame, scalars: DataFrame, steps: int) -> DataFrame:
    """The power iterates ``x0..x{steps}`` of every node."""
    x = [reduce(lambda a, b: a + b, [F.col(f"s{i - 1 - j}") * F.col(f"y{j}") for j in range(i)], F.col(f"c{i}")).alias(f"x{i}")
         for i in range(steps + 1)]
    return vectors.join(scalars, "bucket").select("bucket", "host", "n", "dangling", "parts", *x)


def whole_graph(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, alpha: float, tol: float,
                max_iter: int) -> tuple[np.ndarray, bool]:
    """Power iteration of one graph of nodes 0..n-1: the ranks, and whether they met the tolerance."""
    out = np.bincount(src, weight, n)
    p, dangling, x = alpha * weight / out[src], out == 0, np.full(n, 1.0 / n)
    for _ in range(max_iter):
        last = x
        x = np.bincount(dst, p * last[src], n) + (alpha * last[dangling].sum() + 1.0 - alpha) / n
        if np.abs(x - last).sum() < n * tol:
            return x, True
    return x, False


def _whole_graphs(edges: DataFrame, weight: str, alpha: float, tol: float, max_iter: int) -> DataFrame:
    """``bucket, host, pagerank, met``: one task per graph."""
    def run(table: pa.Table) -> pa.Table:
        src, dst = (table[c].combine_chunks() for c in ("src", "dst"))
        hosts = pa.concat_arrays([src, dst]).dictionary_encode()
        index = hosts.indices.to_numpy()
        x, met = whole_graph(index[:len(src)], index[len(src):], table["w"].to_numpy(), len(hosts.dictionary), alpha, tol,
                             max_iter)
        n = len(x)
        return pa.Table.from_arrays([pa.repeat(table["bucket"][0], n), hosts.dictionary, pa.array(x), pa.array([met] * n)],
                                    names=["bucket", "host", "pagerank", "met"])

    kind = edges.schema["bucket"].dataType.simpleString()
    return (edges.select("bucket", "src", "dst", F.col(weight).cast("double").alias("w")).groupBy("bucket")
            .applyInArrow(run, f"bucket {kind}, host string, pagerank double, met boolean"))


def pagerank(edges: DataFrame, alpha: float = ALPHA, tol: float = TOL, max_iter: int = MAX_ITER,
             weight: str = "flow_count", steps: int = STEPS, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(bucket, host, pagerank)`` for every node of every bucket; no rows for no edges.

    Raises, naming some of the buckets, if any is still moving after ``max_iter`` steps.
    ``edges`` is read several times: materialise it first if it is dear."""
    spark = edges.sparkSession
    base = scratch_path(spark, "pagerank")
    sizes = edges.groupBy("bucket").agg(F.count(F.lit(1)).alias("_edges"))        # one row per bucket
    sized = edges.join(sizes, "bucket")
    _whole_graphs(sized.where(F.col("_edges") <= task_edges), weight, alpha, tol, max_iter).write.parquet(f"{base}/whole")
    whole = spark.read.parquet(f"{base}/whole")
    _named(whole.where("NOT met").select("bucket").distinct(), max_iter)
    ranks = whole.select("bucket", "host", "pagerank")
    if sizes.where(F.col("_edges") > task_edges).isEmpty():
        return ranks
    large = sized.where(F.col("_edges") > task_edges).drop("_edges")
    return ranks.unionByName(spread_graphs(large, alpha, tol, max_iter, weight, steps))


def _named(moving: DataFrame, max_iter: int) -> None:
    left = [str(r[0]) for r in moving.limit(5).collect()]
    if left:
        raise RuntimeError(f"no convergence within {max_iter} steps, e.g. in buckets {left}")


def spread_graphs(edges: DataFrame, alpha: float = ALPHA, tol: float = TOL, max_iter: int = MAX_ITER,
                  weight: str = "flow_count", steps: int = STEPS) -> DataFrame:
    """The same for graphs of any size, spread over the cluster."""
    spark = edges.sparkSession
    base = scratch_path(spark, "pagerank")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    nodes = written(node_table(edges, weight), "nodes")
    hot = (nodes.agg(F.max("parts")).first()[0] or 1) > 1
    keys = ["bucket", "src", "part"] if hot else ["bucket", "src"]
    arcs = _arcs(edges, nodes, weight, keys).persist()
    start = nodes.select("bucket", "host", "n", F.col("w").isNull().cast("double").alias("dangling"),
                         F.col("parts").cast("double").alias("parts"), (F.lit(1.0) / F.col("n")).alias("c0"))
    first = None
    for number, done in enumerate(range(0, max_iter, steps)):
        m = min(steps, max_iter - done)
        state, carried = start, ["n", "dangling", "parts", "c0"]
        for i in range(m):
            state = _push(state, arcs, keys, carried, i, alpha)
            carried = [*carried, f"c{i + 1}"]
        vectors = written(state, f"push-{number}")
        if first is None:
            first = vectors.select("bucket", "host", *[F.col(f"c{j}").alias(f"y{j}") for j in range(m)])
            # u is the first start: both families of vectors are one
            vectors = vectors.select("*", *[F.col(f"c{j}").alias(f"y{j}") for j in range(m)])
        else:
            vectors = vectors.join(first, ["bucket", "host"])
        x = written(_iterates(vectors, _scalars(vectors, m, alpha), m), f"iterates-{number}")
        moved = x.groupBy("bucket").agg(F.max("n").alias("n"), *[
            F.sum(F.abs(F.col(f"x{i}") - F.col(f"x{i - 1}"))).alias(f"d{i}") for i in range(1, m + 1)])
        # one row per bucket: the first step that met the tolerance
        met = written(moved.select("bucket", F.coalesce(*[
            F.when(F.col(f"d{i}") < F.col("n") * F.lit(tol), i) for i in range(1, m + 1)]).alias("met")), f"met-{number}")
        rank = reduce(lambda a, i: a.when(F.col("met") == i, F.col(f"x{i}")), range(2, m + 1),
                      F.when(F.col("met") == 1, F.col("x1")))
        (x.join(met.where("met IS NOT NULL"), "bucket").select("bucket", "host", rank.alias("pagerank"))
         .write.parquet(f"{base}/ranks/round={number}"))
        left = not met.where("met IS NULL").isEmpty()
        start = x.join(met.where("met IS NULL").select("bucket"), "bucket").select(
            "bucket", "host", "n", "dangling", "parts", F.col(f"x{m}").alias("c0"))
        for name, back in (("push", 1), ("iterates", 1), ("met", 1)):
            if number - back > 0 or (number == back and name != "push"):        # the first push serves all rounds
                delete_path(spark, f"{base}/{name}-{number - back}")
        if not left:
            break
    arcs.unpersist()
    if left:
        _named(met.where("met IS NULL").select("bucket"), max_iter)
    for name in ("nodes", "push-0", f"push-{number}", f"iterates-{number}", f"met-{number}"):
        delete_path(spark, f"{base}/{name}")
    return spark.read.parquet(f"{base}/ranks").select("bucket", "host", "pagerank")
