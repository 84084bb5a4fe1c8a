"""Materialised stage outputs, written once per session and scale-factor folder.

The analysed pipeline hands files from stage to stage (host features, enriched flows,
fitted model).  Here the same stages are written as parquet / a saved Spark ML model under
the cluster's checkpoint folder and read back: later queries start from the file (a short
lineage that survives executor loss) instead of recomputing PageRank per query.
"""
from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as EN
from ..operators import models as ML
from ..operators.edges import with_bucket
from ..operators.splits import day_split
from ..session import compilable_methods, scratch_path
from ..sources.flows import events_flows
from ..sources.tables import read_table

FEATURE_WIDTH = "1 day"
_PATHS: dict = {}


def _key(spark: SparkSession, sf: str, name: str):
    """A stage belongs to the files it was made from: their names, sizes and times."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = []
    for f in read_table(spark, sf, "events").inputFiles():
        p = hadoop.Path(f)
        st = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        files.append((f, st.getLen(), st.getModificationTime()))
    return (spark.sparkContext.applicationId, tuple(sorted(files)), name)


def cached(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    k = _key(spark, sf, name)
    if k not in _PATHS:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _PATHS[k] = path
    return spark.read.parquet(_PATHS[k])


def host_features(spark: SparkSession, sf: str, width: str = FEATURE_WIDTH) -> DataFrame:
    from .host_table import host_feature_table
    return cached(spark, sf, f"host-features-{width.replace(' ', '')}",
                   lambda: host_feature_table(events_flows(spark, sf), width, True))


def enriched_flows(spark: SparkSession, sf: str, width: str = FEATURE_WIDTH) -> DataFrame:
    def build():
        fl = with_bucket(events_flows(spark, sf), width)
        return EN.enrich_flows(fl, host_features(spark, sf, width))
    return cached(spark, sf, f"enriched-flows-{width.replace(' ', '')}", build)


def labelled(spark: SparkSession, sf: str, width: str = FEATURE_WIDTH) -> DataFrame:
    """All enriched flows, on every day, with the binary target."""
    return enriched_flows(spark, sf, width).withColumn(
        "y", F.when(F.col("label").eqNullSafe(F.lit("BENIGN")), 0).otherwise(1))


def day_labelled(spark: SparkSession, sf: str, width: str = FEATURE_WIDTH) -> DataFrame:
    """Labelled flows of the day-split protocol: training and test weekdays only."""
    return day_split(labelled(spark, sf, width))


def feature_cols(spark: SparkSession, sf: str, with_graph: bool = True) -> list[str]:
    return ML.feature_columns(labelled(spark, sf), with_graph)


def model_path(spark: SparkSession, sf: str, max_iter: int = ML.BINARY_ROUNDS) -> str:
    day_split_model(spark, sf, max_iter)
    return _PATHS[_key(spark, sf, f"gbt-{max_iter}")]


def day_split_model(spark: SparkSession, sf: str, max_iter: int = ML.BINARY_ROUNDS) -> PipelineModel:
    """Boosted-tree model trained on the training days with flow + graph features."""
    k = _key(spark, sf, f"gbt-{max_iter}")
    if k not in _PATHS:
        data = day_labelled(spark, sf)
        cols = ML.feature_columns(data, True)
        model = ML.fit_gbt(ML.as_float(data.where(F.col("side") == "train"), cols), cols, max_iter=max_iter)
        path = scratch_path(spark, "gbt-model")
        ML.save_model(model, path)
        _PATHS[k] = path
    return ML.load_model(_PATHS[k])


def scored_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Every flow, on every day, with the class and probability of the saved model."""
    def build():
        data = labelled(spark, sf)
        s = ML.score(day_split_model(spark, sf), ML.as_float(data, ML.feature_columns(data, True)))
        return s.select("row_id", "label", "day", "y", "pred", "attack_probability")
    with compilable_methods(spark):
        return cached(spark, sf, "scored-flows", build)
