"""Spark ML stages for the detection experiments.

The saved and explained model is Spark ML's (distributed tree learning); the many fits of the
experiments are ``boosting``.  Everything around them — feature choice, imputation fitted on the
training slice only, scoring, metrics — stays in DataFrames.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import compilable_methods
from . import boosting as BO
from .features import FEATURE_COLUMNS

# Columns that identify a flow rather than describe it (never features).
ID_COLUMNS = ("row_id", "src", "dst", "ts", "label", "day", "bucket", "source_file",
              "capture_pos", "y", "pred", "flagged", "side", "is_test", "is_holdout")
GRAPH_PREFIXES = ("src_", "dst_")
EXCLUDED_GRAPH = ("src_clustering_coefficient", "dst_clustering_coefficient")
RELATIVE_ERROR = 1e-4        # median imputation: near-exact quantile
# Boosting rounds and depths of the analysed protocols.
BINARY_ROUNDS, BINARY_DEPTH = 200, 6
MULTI_ROUNDS, MULTI_DEPTH = 300, 8
ZERO_DAY_ROUNDS = 150
LEARNING_RATE = 0.1


def is_graph_feature(c: str) -> bool:
    """``src_<feature>`` / ``dst_<feature>`` for one of the 13 host-bucket features
    (a flow column such as ``dst_port`` is not one)."""
    return c.startswith(GRAPH_PREFIXES) and c[4:] in FEATURE_COLUMNS


def feature_columns(df: DataFrame, with_graph: bool = True, extra_exclude: tuple = ()) -> list[str]:
    """Numeric columns by exclusion; graph features by name, clustering excluded."""
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in ID_COLUMNS or c in extra_exclude or not isinstance(f.dataType, NumericType):
            continue
        if is_graph_feature(c):
            if not with_graph or c in EXCLUDED_GRAPH:
                continue
        out.append(c)
    return out


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Schema-only check (no data read) that a saved feature list fits the input table."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"input lacks the model's feature columns: {missing}")


def as_float(df: DataFrame, cols: list[str]) -> DataFrame:
    """Narrow the features to float (halves memory; ML vectors widen to double)."""
    keep = [F.col(c).cast("float").alias(c) if c in cols else F.col(c) for c in df.columns]
    return df.select(*keep)


def imputer(cols: list[str]) -> Imputer:
    return Imputer(inputCols=cols, outputCols=[f"{c}__imp" for c in cols],
                   strategy="median", relativeError=RELATIVE_ERROR)


def gbt_pipeline(cols: list[str], label_col: str = "y", max_iter: int = BINARY_ROUNDS,
                 max_depth: int = BINARY_DEPTH, step_size: float = LEARNING_RATE, seed: int = 42) -> Pipeline:
    """Median imputation (fitted on the training slice) -> vector -> boosted trees.
    Trees cannot take missing values, so imputation comes first."""
    imp = imputer(cols)
    va = VectorAssembler(inputCols=imp.getOutputCols(), outputCol="features")
    gbt = GBTClassifier(labelCol=label_col, featuresCol="features", maxIter=max_iter,
                        maxDepth=max_depth, stepSize=step_size, seed=seed)
    return Pipeline(stages=[imp, va, gbt])


def fit_gbt(train: DataFrame, cols: list[str], label_col: str = "y", **kwargs) -> PipelineModel:
    """``gbt_pipeline`` fitted on ``train``.  The learner reads its rows three times before it keeps them binned, so the
    imputed vectors are made once and stay on the executors' disks meanwhile, dealt as the rows of ``train`` are."""
    impute, assemble, trees = gbt_pipeline(cols, label_col, **kwargs).getStages()
    with compilable_methods(train.sparkSession):
        imputed = impute.fit(train)
        vectors = assemble.transform(imputed.transform(train)).select(label_col, "features").persist(StorageLevel.DISK_ONLY)
        try:
            fitted = trees.fit(vectors)
        finally:
            vectors.unpersist()
    return PipelineModel([imputed, assemble, fitted])


def score(model: PipelineModel, df: DataFrame, pred: str = "pred", proba: str = "attack_probability") -> DataFrame:
    """Class and attack probability per row (``vector_to_array`` stays in the JVM)."""
    for stage in model.stages:                     # the imputer holds the feature list
        if isinstance(stage, ImputerModel):
            require_columns(df, stage.getInputCols())
    s = model.transform(df)
    return (s.withColumn(pred, F.col("prediction").cast("int"))
            .withColumn(proba, vector_to_array("probability")[1])
            .drop("features", "rawPrediction", "probability", "prediction",
                  *[c for c in s.columns if c.endswith("__imp")]))


def label_index(train: DataFrame, label_col: str = "label") -> DataFrame:
    """The alphabetical class index training defines, as a table (one row per class, so the
    ranking window holds the classes only)."""
    classes = train.where(F.col(label_col).isNotNull()).select(label_col).distinct()
    return classes.withColumn("label_index", (F.dense_rank().over(Window.orderBy(label_col)) - 1).cast("double"))


def gain_importance(spark, model: PipelineModel, cols: list[str], top: int = 20) -> DataFrame:
    """Normalised total-gain importance of the fitted trees, top ``top`` features, with
    a flag for graph features.  The importance vector has one entry per feature."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(cols, imp), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(
        [(i + 1, c, float(g), is_graph_feature(c)) for i, (c, g) in enumerate(rows)],
        "rank int, feature string, gain double, is_graph_feature boolean")


def mean_gain(spark, model: PipelineModel, path: str, cols: list[str], top: int = 20) -> DataFrame:
    """Gain per split, averaged over the splits on a feature, from the node table of the saved trees: ``feature,
    n_splits, mean_gain, is_graph_feature``, largest first.  Features never split on are left out."""
    from .attribution import stage_path
    nodes = spark.read.parquet(stage_path(path, model, -1) + "/data").where("nodeData.leftChild >= 0")
    names = F.array(*[F.lit(c) for c in cols])
    graph = F.array(*[F.lit(is_graph_feature(c)) for c in cols])
    at = F.col("feature_index") + 1
    return (nodes.groupBy(F.col("nodeData.split.featureIndex").alias("feature_index"))
            .agg(F.count(F.lit(1)).alias("n_splits"), F.avg("nodeData.gain").alias("mean_gain"))
            .select(F.element_at(names, at).alias("feature"), "n_splits", "mean_gain",
                    F.element_at(graph, at).alias("is_graph_feature"))
            .orderBy(F.col("mean_gain").desc(), "feature").limit(top))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def boosted(train: DataFrame, cols: list[str], label_col: str | None = None, rounds: int | None = None,
            depth: int | None = None) -> BO.Booster:
    """A booster with the protocols' rounds and depth: of the binary target ``y``, or with ``label_col``
    of all its classes at once."""
    if label_col:
        return BO.fit(as_float(train, cols), cols, label_col, rounds or MULTI_ROUNDS, depth or MULTI_DEPTH, LEARNING_RATE)
    return BO.fit(as_float(train, cols), cols, "y", rounds or BINARY_ROUNDS, depth or BINARY_DEPTH, LEARNING_RATE, binary=True)


def boosted_scores(df: DataFrame, model: BO.Booster, keep: tuple[str, ...] = ("row_id", "label", "y")) -> DataFrame:
    """``pred`` and ``attack_probability`` of a binary booster beside the kept columns."""
    return (BO.predict(as_float(df, model.columns), model, keep)
            .withColumn("attack_probability", F.get("probabilities", F.lit(1)))
            .withColumnRenamed("pred_index", "pred").drop("probabilities"))


def zero_day_rates(train_base: DataFrame, holdout: DataFrame, cols: list[str], classes: list[str | None],
                   label_col: str = "label", max_iter: int = ZERO_DAY_ROUNDS, at_once: int | None = None) -> list[dict]:
    """Leave-one-class-out: for each attack class train without it, then its catch rate and
    the false-positive rate on a fixed benign holdout.  One fit per class,
    ``at_once`` of them side by side (None: as many as there are cores); the data stays in the cluster.  A NULL label is a class
    like any other (None among ``classes``)."""
    base = train_base.persist()

    def fold(cls: str | None) -> dict:
        left_out = F.col(label_col).eqNullSafe(F.lit(cls))
        model = boosted(base.where(~left_out), cols, rounds=max_iter)
        r = (boosted_scores(base.where(left_out), model, (label_col,))
             .agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("rate")).first())
        fpr = boosted_scores(holdout, model, (label_col,)).agg(F.avg("pred").alias("fpr")).first()["fpr"]
        return {"class": cls, "support": int(r["n"]), "zero_day_catch_rate": float(r["rate"] or 0.0),
                "benign_fpr": float(fpr or 0.0)}

    with ThreadPoolExecutor(at_once or max(1, min(len(classes), base.sparkSession.sparkContext.defaultParallelism))) as pool:
        out = list(pool.map(fold, classes))
    base.unpersist()
    return out
