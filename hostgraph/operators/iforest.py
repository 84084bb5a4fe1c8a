"""Isolation forest (Liu, Ting & Zhou, 2008) on Spark.

* Subsamples: each tree draws its own ``sample_size`` rows without replacement, by its own
  seeded hash, so trees share rows as independent draws do and all trees asked for are built
  whatever the table's size.  They draw from the ``n_trees * sample_size`` rows of smallest
  ``md5(seed|id)`` (the whole table if it is smaller), found with a filter ahead of the shuffle.
* Trees: ``groupBy(tree).applyInPandas`` — one task per tree, each on exactly
  ``sample_size`` rows (a fixed bound), random axis-parallel splits up to
  ``ceil(log2(sample_size))`` levels, seeded per tree.
* Scoring: the node table (at most ``n_trees * (2 * sample_size - 1)`` rows, a fixed
  bound) is broadcast into ``mapInPandas``; Arrow batches of rows walk all trees with
  vectorised numpy.  Score s = 2 ** (-E[h(x)] / c(rows of a tree)); outlier iff s > 0.5
  (the ``contamination="auto"`` rule).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .splits import stratified_sample

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")


def c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _build_tree(pdf: pd.DataFrame, cols: list[str], seed: int, max_depth: int) -> pd.DataFrame:
    tree = int(pdf["_tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    X = pdf[cols].to_numpy(dtype=float)
    rows = []

    def grow(idx, depth):
        node = len(rows)
        rows.append(None)
        sub = X[idx]
        if depth >= max_depth or len(idx) <= 1:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        left_idx, right_idx = idx[sub[:, f] < t], idx[sub[:, f] >= t]
        left = grow(left_idx, depth + 1)
        right = grow(right_idx, depth + 1)
        rows[node] = (tree, node, f, t, left, right, len(idx), depth)
        return node

    grow(np.arange(len(X)), 0)
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right",
                                       "size", "depth"])


def fit(df: DataFrame, cols: list[str], id_col: str = "row_id", n_trees: int = 200,
        sample_size: int = 256, seed: int = 42) -> pd.DataFrame:
    """Node table of the forest (``n_trees * (2 * sample_size - 1)`` rows at most)."""
    pool = stratified_sample(df.select(id_col, *cols), None, n_trees * sample_size, id_col, seed)
    pool = pool.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))   # a bounded table
    # of the pool's n rows a tree looks at those whose hash is below a bound that leaves more
    # than sample_size of them (by six standard deviations), and ranks these
    share = F.least(F.lit(1.0), (sample_size + 6 * math.sqrt(sample_size) + 16) / F.col("_n"))
    drawn = (pool.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
             .withColumn("_h", F.xxhash64(F.lit(seed), "_tree", id_col))
             .where(F.shiftrightunsigned("_h", 11) / float(1 << 53) < share))
    own = Window.partitionBy("_tree").orderBy("_h", id_col)
    sample = (drawn.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= sample_size)
              .select("_tree", *cols))
    depth = int(math.ceil(math.log2(sample_size)))
    nodes = sample.groupBy("_tree").applyInPandas(lambda p: _build_tree(p, cols, seed, depth), NODE_SCHEMA)
    return nodes.toPandas()


def score(df: DataFrame, forest: pd.DataFrame, cols: list[str],
          out: str = "anomaly_score", flag: str = "is_outlier") -> DataFrame:
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(forest.sort_values(["tree", "node"]).reset_index(drop=True))
    roots = forest.loc[forest["depth"] == 0, "size"]
    norm = float(c_factor([roots.mean()])[0])
    schema = StructType(list(df.schema.fields) + [StructField(out, DoubleType()),
                                                  StructField(flag, BooleanType())])

    def run(batches):
        f = bc.value
        trees = [g.reset_index(drop=True) for _, g in f.groupby("tree")]
        arrays = [(g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(),
                   g["right"].to_numpy(), g["size"].to_numpy(), g["depth"].to_numpy()) for g in trees]
        for pdf in batches:
            X = pdf[cols].to_numpy(dtype=float)
            total = np.zeros(len(pdf))
            for feat, thr, left, right, size, dep in arrays:
                node = np.zeros(len(pdf), dtype=int)
                while True:
                    active = feat[node] >= 0
                    if not active.any():
                        break
                    fa = feat[node[active]]
                    go_left = X[np.flatnonzero(active), fa] < thr[node[active]]
                    nxt = np.where(go_left, left[node[active]], right[node[active]])
                    node[active] = nxt
                total += dep[node] + c_factor(size[node])
            s = np.power(2.0, -(total / len(arrays)) / norm)
            yield pdf.assign(**{out: s, flag: s > 0.5})

    return df.mapInPandas(run, schema)
