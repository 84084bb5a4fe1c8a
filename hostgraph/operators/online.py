"""Baselines and first contacts carried forward from batch to batch of buckets.

``features`` works out every bucket from the whole history.  Here a state table holds what the history
leaves behind, and a new bucket (or several) costs itself and the state:

* hosts: per host and feature the number, mean and squared deviations ``m2`` of all its values so far, and its
  degree in the last bucket;
* pairs: every (src, dst) seen, appended by each batch;
* the last bucket.

Statistics merge by the pairwise rule (Chan, Golub & LeVeque, 1983): for a part of n_a values and one of n_b,

    mean = mean_a + d * n_b / n,   m2 = m2_a + m2_b + d^2 * n_a * n_b / n,   d = mean_b - mean_a,  n = n_a + n_b

so a batch of several buckets takes its own earlier rows from a window and everything before from the state.
Versions are folders: a batch that fails half-way leaves the last version as it was and is done again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import delete_path, materialize
from .features import MIN_OBSERVATIONS, ZSCORE_EPS, endpoint_stats

HOSTS = "host string, last_degree long, in_last boolean, " + ", ".join(
    f"{f}_n long, {f}_mean double, {f}_m2 double" for f in ZSCORE_EPS)
PAIRS = "src string, dst string"


def merged(n_a, mean_a, m2_a, n_b, mean_b, m2_b) -> tuple:
    """Columns (n, mean, m2) of two parts together; a part of no values has mean and m2 0."""
    n, d = n_a + n_b, mean_b - mean_a
    share = F.when(n > 0, n_b / n).otherwise(0.0)
    mean = F.when(n_a == 0, mean_b).when(n_b == 0, mean_a).otherwise(mean_a + d * share)
    return n, mean, m2_a + m2_b + F.when((n_a > 0) & (n_b > 0), d * d * n_a * share).otherwise(0.0)


def _part(feature: str, over=None) -> tuple:
    """(n, mean, m2) of a feature's values in a group, or in a window."""
    v = F.col(feature).cast("double")
    agg = [F.count(v), F.avg(v), F.var_pop(v) * F.count(v)] if over is None else [
        F.count(v).over(over), F.avg(v).over(over), F.var_pop(v).over(over) * F.count(v).over(over)]
    return agg[0], F.coalesce(agg[1], F.lit(0.0)), F.coalesce(agg[2], F.lit(0.0))


class OnlineFeatures:
    """The state below a folder of the shared store; ``advance`` takes the edges of new buckets."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path.rstrip("/"), 0
        done = self._read("done", "version int, last_bucket timestamp_ntz").orderBy(F.col("version").desc()).first()
        self.last_bucket = None
        if done:
            self.version, self.last_bucket = done["version"], done["last_bucket"]

    def _read(self, name: str, schema: str | StructType) -> DataFrame:
        """All versions of a table; an empty frame before the first."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema).withColumn("v", F.lit(0))
        plain = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        return self.spark.read.schema(plain + ", v int").parquet(f"{self.path}/{name}")

    def hosts(self) -> DataFrame:
        return self._read("hosts", HOSTS).where(F.col("v") == self.version).drop("v")

    def pairs(self) -> DataFrame:
        """Every pair seen, up to the last finished batch."""
        return self._read("pairs", PAIRS).where(F.col("v") <= self.version).drop("v")

    def features(self) -> DataFrame:
        """The features of all buckets so far, as the batches wrote them."""
        return self.spark.read.parquet(f"{self.path}/features").where(F.col("v") <= self.version).drop("v")

    def advance(self, edges: DataFrame) -> DataFrame:
        """The features of the edges' buckets, all of which must be later than any before; written, and the
        state moved on.  No edges: nothing changes."""
        edges = materialize(edges.select("bucket", "src", "dst", "flow_count", "total_bytes"))
        span = edges.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).first()
        if span["a"] is None:
            return self.features().limit(0) if self.version else edges.sparkSession.createDataFrame([], "bucket timestamp_ntz, host string")
        if self.last_bucket is not None and span["a"] <= self.last_bucket:
            raise ValueError(f"bucket {span['a']} is not later than {self.last_bucket}")
        v = self.version + 1

        # first contacts: known pairs among the new ones (the state is scanned, the new pairs decide what moves)
        first = edges.groupBy("src", "dst").agg(F.min("bucket").alias("fb"))
        known = self.pairs().join(first.select("src", "dst"), ["src", "dst"], "left_semi").distinct()
        fresh = first.join(known, ["src", "dst"], "left_anti")
        fresh.select("src", "dst").write.mode("overwrite").parquet(f"{self.path}/pairs/v={v}")
        marked = edges.join(fresh, ["src", "dst"], "left").withColumn(
            "is_new", F.coalesce((F.col("bucket") == F.col("fb")).cast("int"), F.lit(0))).drop("fb")
        stats = materialize(endpoint_stats(marked))

        # positions of the new buckets: one row per bucket of the batch
        order = Window.orderBy("bucket")
        place = stats.select("bucket").distinct().withColumn("place", F.row_number().over(order))
        w = Window.partitionBy("host").orderBy("bucket")
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        degree = F.col("fan_in") + F.col("fan_out")
        prior = self.hosts()
        rows = stats.join(place, "bucket").join(prior, "host", "left")
        previous = F.when(F.lag("place").over(w) == F.col("place") - 1, F.lag(degree).over(w)).when(
            (F.col("place") == 1) & F.col("in_last"), F.col("last_degree"))
        cols = [(degree / previous).alias("degree_ratio_change")]
        zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind))
        state = lambda f: (zero(f"{f}_n", "long"), zero(f"{f}_mean", "double"), zero(f"{f}_m2", "double"))
        for f, eps in ZSCORE_EPS.items():
            n, mean, m2 = merged(*state(f), *_part(f, earlier))
            name = "novelty_zscore" if f == "novelty_score" else f"{f}_zscore"
            cols.append(F.when(F.col(f).isNotNull() & (n >= MIN_OBSERVATIONS),
                               (F.col(f) - mean) / (F.sqrt(m2 / (n - 1)) + F.lit(eps))).alias(name))
        out = rows.select("bucket", "host", "fan_out", "fan_in", "flow_volume", "byte_volume", "novelty_score", *cols)
        out.write.mode("overwrite").parquet(f"{self.path}/features/v={v}")

        # the state after the batch
        parts = [x.alias(f"{f}_{k}") for f in ZSCORE_EPS for k, x in zip(("bn", "bmean", "bm2"), _part(f))]
        last = stats.where(F.col("bucket") == F.lit(span["b"])).select("host", degree.alias("new_degree"))
        batch = stats.groupBy("host").agg(*parts).join(last, "host", "left")
        both = prior.join(batch, "host", "full_outer")
        keep = []
        for f in ZSCORE_EPS:
            new = (zero(f"{f}_bn", "long"), zero(f"{f}_bmean", "double"), zero(f"{f}_bm2", "double"))
            keep += [x.alias(f"{f}_{k}") for k, x in zip(("n", "mean", "m2"), merged(*state(f), *new))]
        both.select("host", F.col("new_degree").alias("last_degree"), F.col("new_degree").isNotNull().alias("in_last"),
                    *keep).write.mode("overwrite").parquet(f"{self.path}/hosts/v={v}")
        self.spark.createDataFrame([(v, span["b"])], "version int, last_bucket timestamp_ntz").write.mode(
            "overwrite").parquet(f"{self.path}/done/v={v}")
        if v > 1:
            delete_path(self.spark, f"{self.path}/hosts/v={v - 1}")
        self.version, self.last_bucket = v, span["b"]
        return self.spark.read.parquet(f"{self.path}/features/v={v}")
