"""Additive feature attributions of a Spark boosted-tree model.

Exact path-dependent TreeSHAP (Lundberg, Erion & Lee, 2018) in a form that vectorises over
rows.  For a leaf reached by the path root -> leaf, let U be the distinct features split on
along the path (d = |U|); for feature j in U, z_j is the product of the cover fractions of
the path's edges on j and o_j(x) is 1 when x follows all of them.  The leaf's value v adds

    phi_i += v * (o_i - z_i) * sum_s  s! (d - s - 1)! / d!  *  [t^s] prod_{j in U, j != i} (z_j + o_j t)

to every i in U — the closed form the EXTEND / UNWIND recursion of the paper evaluates.
All rows of an Arrow batch are processed together: per leaf, the o_j are boolean vectors and
the polynomial products are small numpy arrays (d <= tree depth).

The o_j depend on nothing but which of the path's conditions a row meets, so each leaf's additions are worked out
once for every bit pattern of its conditions: neighbouring leaves of at most ``TABLE_BITS`` conditions together share
one table, and a row costs one lookup per table and feature.  Leaves with more conditions of their own are worked out
row by row.

The trees come from the saved Spark model (one row per node, ``rawCount`` = cover); they
are at most ``trees * 2^(depth+1)`` nodes and are broadcast with their tables.  Rows are spread over tasks by
``mapInArrow``, so any number of rows can be explained.
Log-odds convention: Spark's probability is sigmoid(2 * sum_t w_t tree_t(x)), so every leaf
value is scaled by 2 * w_t and ``base + sum(phi) == log-odds`` of the row.
"""
from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_BITS = 8         # conditions of a table (a pattern is one byte): it has 2 to that power entries per feature
CHUNK_ROWS = 8_192     # rows looked up at a time, so that they stay in the processor's cache


def stage_path(model_path: str, model: PipelineModel, index: int = -1) -> str:
    """Folder of one stage inside a saved pipeline: ``stages/<zero-padded index>_<uid>``
    (the pipeline writer's layout).  Built from the model, not by listing a folder, so it
    works on any shared file system."""
    n = len(model.stages)
    i = index % n
    return f"{model_path.rstrip('/')}/stages/{str(i).zfill(len(str(n)))}_{model.stages[i].uid}"


def load_tree_nodes(spark: SparkSession, model_path: str, model: PipelineModel | None = None) -> pd.DataFrame:
    """Node table of the boosted-tree stage of a saved pipeline (small by construction)."""
    if model is None:
        model = PipelineModel.load(model_path)
    stage = stage_path(model_path, model, -1)
    nodes = spark.read.parquet(stage + "/data").select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.rawCount").alias("cover"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold"))
    return nodes.toPandas()


def leaf_paths(nodes: pd.DataFrame, weights: list[float]) -> tuple[list, float]:
    """Per leaf: (scaled value, [(feature, z, [(threshold, went_left), ...]), ...]) and the
    base value (cover-weighted mean of the scaled leaf values)."""
    leaves, base = [], 0.0
    for tid, t in nodes.groupby("treeID"):
        t = t.set_index("id")
        scale = 2.0 * weights[int(tid)]
        root_cover = float(t.loc[0, "cover"])

        def walk(nid, path):
            nonlocal base
            n = t.loc[nid]
            if n["left"] < 0:
                feats = {}
                for f, frac, thr, went_left in path:
                    z, conds = feats.get(f, (1.0, []))
                    feats[f] = (z * frac, conds + [(thr, went_left)])
                v = scale * float(n["value"])
                leaves.append((v, [(f, z, conds) for f, (z, conds) in feats.items()]))
                base += v * float(n["cover"]) / root_cover
                return
            f, thr, cover = int(n["feature"]), float(n["threshold"]), float(n["cover"])
            for child, went_left in ((int(n["left"]), True), (int(n["right"]), False)):
                frac = float(t.loc[child, "cover"]) / cover if cover > 0 else 0.0
                walk(child, path + [(f, frac, thr, went_left)])

        walk(0, [])
    return leaves, base


def _coef(d: int) -> np.ndarray:
    return np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])


def _leaf_additions(v: float, z: list[float], o: np.ndarray) -> np.ndarray:
    """What a leaf adds to each of its features (features x rows); ``o``: whether a row follows its edges on them."""
    d, n = o.shape
    own = np.eye(d)[:, :, None]                      # a feature's own factor is left out of its product
    poly = np.ones((d, n, 1))
    for j in range(d):
        nxt = np.zeros((d, n, poly.shape[2] + 1))
        nxt[:, :, :-1] += poly * np.where(own[j] == 1, 1.0, z[j])[:, :, None]
        nxt[:, :, 1:] += poly * np.where(own[j] == 1, 0.0, o[j])[:, :, None]
        poly = nxt
    return v * (o - np.array(z)[:, None]) * (poly[:, :, :d] @ _coef(d))


def leaf_tables(leaves: list) -> tuple[list, list]:
    """``(tables, others)``: each table ``(conditions, features, additions)`` holds what its leaves add to their
    features for every bit pattern of its conditions (bit j: ``x[f] <= threshold`` of the j-th); ``others`` are the
    leaves of more than ``TABLE_BITS`` conditions."""
    groups: list[tuple[dict, list]] = []
    others = []
    for leaf in leaves:
        feats = leaf[1]
        if not feats:
            continue
        own = [(f, thr) for f, _z, conds in feats for thr, _left in conds]
        if len(set(own)) > TABLE_BITS:
            others.append(leaf)
            continue
        if not groups or len(set(own) | groups[-1][0].keys()) > TABLE_BITS:
            groups.append(({}, []))
        at, members = groups[-1]
        for c in own:
            at.setdefault(c, len(at))
        members.append(leaf)
    tables = []
    for at, members in groups:
        patterns = np.arange(2 ** len(at))
        met = {c: (patterns >> j & 1).astype(bool) for c, j in at.items()}
        added: dict[int, np.ndarray] = {}
        for v, feats in members:
            o = np.array([np.logical_and.reduce([met[f, thr] == left for thr, left in conds]) for f, _z, conds in feats])
            for (f, _z, _c), x in zip(feats, _leaf_additions(v, [z for _f, z, _c in feats], o.astype(float))):
                added[f] = added.get(f, 0.0) + x
        tables.append((list(at), list(added), np.stack(list(added.values()))))
    return tables, others


def table_values(X: np.ndarray, tables: list, others: list, n_features: int) -> np.ndarray:
    """phi (rows x features) for a batch, from ``leaf_tables``."""
    phi = np.zeros((n_features, X.shape[0]))
    for start in range(0, X.shape[0], CHUNK_ROWS):
        x = np.ascontiguousarray(X[start:start + CHUNK_ROWS].T)
        out = np.zeros((n_features, x.shape[1]))
        for conditions, features, additions in tables:
            pattern = np.zeros(x.shape[1], np.uint8)
            for j, (f, thr) in enumerate(conditions):
                pattern |= (x[f] <= thr).view(np.uint8) << np.uint8(j)
            at = pattern.astype(np.intp)
            for f, added in zip(features, additions):
                out[f] += added.take(at)
        for v, feats in others:
            o = np.array([np.logical_and.reduce([(x[f] <= thr) == left for thr, left in conds]) for f, _z, conds in feats])
            for (f, _z, _c), added in zip(feats, _leaf_additions(v, [z for _f, z, _c in feats], o.astype(float))):
                out[f] += added
        phi[:, start:start + CHUNK_ROWS] = out
    return phi.T


def shap_values(X: np.ndarray, leaves: list, n_features: int) -> np.ndarray:
    """phi (rows x features) for a batch."""
    return table_values(X, *leaf_tables(leaves), n_features)


def explain(spark: SparkSession, model: PipelineModel, model_path: str, rows: DataFrame,
            cols: list[str], keep: tuple = ("row_id", "label")) -> DataFrame:
    """Adds ``base``, ``logit`` and ``phi array<double>`` (one entry per feature, in ``cols``
    order) to the rows; rows are imputed by the model's own first stage."""
    gbt = model.stages[-1]
    leaves, base = leaf_paths(load_tree_nodes(spark, model_path, model), list(gbt.treeWeights))
    bc = spark.sparkContext.broadcast((*leaf_tables(leaves), base))
    imputed = model.stages[0].transform(rows)
    imp_cols = model.stages[0].getOutputCols()
    data = imputed.select(*keep, *[F.col(c).cast("double").alias(c) for c in imp_cols])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields if f.name in keep]
                       + ["base double", "logit double", "phi array<double>"])
    n = len(imp_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, others, b = bc.value
        for batch in batches:
            kept = batch.columns[:len(keep)]
            X = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keep):]], 1)
            phi = table_values(X, tables, others, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(X) + 1) * n, pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(X), b)), pa.array(b + phi.sum(axis=1)), lists],
                                             names=[*keep, "base", "logit", "phi"])

    return data.mapInArrow(run, schema)


def long_form(explained: DataFrame, cols: list[str]) -> DataFrame:
    """(row, feature, phi) rows from the array column."""
    names = F.array(*[F.lit(c) for c in cols])
    return (explained.select("*", F.posexplode("phi").alias("_i", "phi_value"))
            .withColumn("feature", F.element_at(names, F.col("_i") + 1))
            .drop("_i", "phi"))


def rank_features(long: DataFrame, top: int = 20, is_graph=None) -> DataFrame:
    """Mean |phi| per feature, largest first."""
    r = long.groupBy("feature").agg(F.avg(F.abs("phi_value")).alias("mean_abs_phi"))
    return r.orderBy(F.col("mean_abs_phi").desc(), "feature").limit(top)


def share_by_label(explained: DataFrame, cols: list[str], graph_mask: list[bool],
                   label_col: str = "label", pred: str = "pred", benign: str = "BENIGN") -> DataFrame:
    """Per label: n, recall, mean total |phi|, mean per-row share of graph features."""
    g_idx = [i for i, g in enumerate(graph_mask) if g]
    absphi = F.transform("phi", lambda x: F.abs(x))
    total = F.aggregate(absphi, F.lit(0.0), lambda acc, x: acc + x)
    graph = F.aggregate(F.filter(F.arrays_zip(absphi.alias("a"), F.sequence(F.lit(0), F.size("phi") - 1).alias("i")),
                                 lambda s: F.array_contains(F.array(*[F.lit(i) for i in g_idx] or [F.lit(-1)]), s["i"])),
                        F.lit(0.0), lambda acc, s: acc + s["a"])
    e = explained.select(label_col, pred, total.alias("_tot"), graph.alias("_g"))
    m = F.avg(F.col(pred).cast("double"))
    return (e.groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("n"), m.alias("_m"), F.avg("_tot").alias("mean_total_abs_phi"),
                 F.avg(F.when(F.col("_tot") > 0, F.col("_g") / F.col("_tot"))).alias("graph_share"))
            .select(label_col, "n", F.when(F.col(label_col) == benign, 1 - F.col("_m")).otherwise(F.col("_m")).alias("recall"),
                    "mean_total_abs_phi", "graph_share", (1 - F.col("graph_share")).alias("flow_share")))
