"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words and the first four and five letters of longer
ones, hashed into buckets.  The buckets whose share differs most between the two labels are kept, and
those that tell beside another one although neither tells alone (chi-square of pairs); on those, Spark ML's factorization machine learns a weight for each and, through its factors, one
for each pair (an insult beside a mention of a group).  Training reads a bounded number of labelled
rows; scoring is one pass over all whole texts without a shuffle.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import hash_sample

FOLDS = 5            # rows whose crc32(doc_id) is 0 modulo this are held out
MAX_ROWS = 20_000    # labelled rows that training reads at most
BUCKETS = 1 << 18
SELECTED = 1024
LEAST = 16.0
PAIRED = 1024        # buckets (those nearest to half of the rows) whose pairs are looked at
LEAST_PAIR = 32.0
FEW = 64             # buckets kept where none tells
BLOCK_ROWS = 5_000   # rows of the sample that one task counts pairs in
FACTORS = 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def terms(text: Column) -> Column:
    """Distinct words and word beginnings; none for a null text."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))

    def heads(n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > n),
                                            lambda w: F.concat(F.lit("^"), F.substring(w, 1, n))))

    return F.filter(F.concat(words, heads(4), heads(5)), lambda w: w != "")


def _features(docs: DataFrame, buckets: int) -> DataFrame:
    return (HashingTF(inputCol="_terms", outputCol="_hashed", numFeatures=buckets, binary=True)
            .transform(docs.withColumn("_terms", terms(F.col("_text")))).drop("_terms", "_text"))


@dataclass
class ToxicityModel:
    """``buckets`` hashed terms, the ``selected`` ones in order, and the machine over them; without
    a machine (labels of one kind or none, or no term at all) every text gets ``rate``."""

    buckets: int
    selected: list[int]
    machine: object | None
    rate: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, score, predicted`` for every row: the probability that label 1 holds, and 1 if
        it is 0.5 or more.  Null and empty texts have no terms and get the machine's bias; null
        ids and repeated rows are scored like others; other columns are not read."""
        d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
        if self.machine is None:
            out = d.select("doc_id", F.lit(float(self.rate)).alias("score"))
        else:
            hashed = _features(d, self.buckets)
            sliced = VectorSlicer(inputCol="_hashed", outputCol="features", indices=self.selected).transform(hashed)
            out = self.machine.transform(sliced.select("doc_id", "features")).select(
                "doc_id", vector_to_array("probability")[1].alias("score"))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _choose(counts: dict[int, tuple[int, np.ndarray]], selected: int, least: float = LEAST) -> list[int]:
    """The buckets whose shares differ most between the labels: squared difference in units of its
    variance, and at least ``least`` of them (chi-square; above 16 one bucket in 16,000 by chance)."""
    (n0, c0), (n1, c1) = counts[0], counts[1]
    rate = (c0 + c1 + 1) / (n0 + n1 + 2)
    z = (c1 / n1 - c0 / n0) ** 2 / (rate * (1 - rate) * (1 / n0 + 1 / n1))
    top = np.lexsort((np.arange(len(z)), -z))[:selected]
    return sorted(int(i) for i in top if z[i] >= least and c0[i] + c1[i])


def _nearest_half(counts: dict[int, tuple[int, np.ndarray]], n: int) -> np.ndarray:
    """The ``n`` buckets, of those that some rows have and others not, of largest variance, in order."""
    (n0, c0), (n1, c1) = counts[0], counts[1]
    rate = (c0 + c1) / (n0 + n1)
    spread = rate * (1 - rate)
    top = np.lexsort((np.arange(len(spread)), -spread))[:n]
    return np.sort(top[spread[top] > 0])


def _interacting(rows: DataFrame, counts: dict[int, tuple[int, np.ndarray]], paired: int, selected: int) -> list[int]:
    """The buckets of the ``selected`` / 2 pairs whose difference of differences between the labels is largest:
    r11 - r10 - r01 + r00 over the label shares of rows with both, one or none, squared and in units of its
    variance, at least ``LEAST_PAIR`` (one pair in 60 million by chance), five rows in every cell.

    Tasks count co-occurrences in blocks of the sample; the sums meet by the pair's first bucket."""
    some = _nearest_half(counts, paired)
    if len(some) < 2:
        return []
    n = np.array([counts[k][0] for k in (0, 1)], float)
    one = np.array([counts[k][1][some] for k in (0, 1)], float)
    share = n[1] / n.sum()
    sliced = VectorSlicer(inputCol="_hashed", outputCol="_some", indices=[int(i) for i in some])
    blocks = sliced.transform(rows.repartition(int(-(-n.sum() // BLOCK_ROWS)), "doc_id")).select(
        "label", vector_to_array("_some", "float32").alias("x"))

    def count(batches):
        both = np.zeros((2, len(some), len(some)), np.float32)
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float32).reshape(b.num_rows, len(some))
            label = np.asarray(b.column(0))
            for k in (0, 1):
                both[k] += x[label == k].T @ x[label == k]
        packed = both.transpose(1, 0, 2).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int32()),
                                          pa.array([p.tobytes() for p in packed], pa.binary())], names=["i", "n"])

    def judge(table: pa.Table) -> pa.Table:
        i = table.column("i")[0].as_py()
        both = sum(np.frombuffer(v.as_py(), "<i4").astype(float) for v in table.column("n")).reshape(2, -1)
        cells = [both, one[:, [i]] - both, one - both, (n[:, None] - one[:, [i]]) - (one - both)]
        size = np.stack([c.sum(0) for c in cells])
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.stack([c[1] for c in cells]) / size
            z = (rate[0] - rate[1] - rate[2] + rate[3]) ** 2 / (share * (1 - share) * (1 / size).sum(0))
        j = np.flatnonzero((size.min(0) >= 5) & (z >= LEAST_PAIR) & (np.arange(len(some)) > i))
        return pa.table({"i": pa.array([i] * len(j), pa.int32()), "j": pa.array(j, pa.int32()), "z": pa.array(z[j], pa.float64())})

    pairs = (blocks.mapInArrow(count, "i int, n binary").groupBy("i").applyInArrow(judge, "i int, j int, z double")
             .orderBy(F.desc("z"), "i", "j").limit(selected // 2).collect())
    return [int(some[k]) for r in pairs for k in (r["i"], r["j"])]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, buckets: int = BUCKETS,
        selected: int = SELECTED, factors: int = FACTORS, iterations: int = 80, step: float = 0.1,
        paired: int = PAIRED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from labelled rows that are not held out: those ``max_rows`` with the smallest hash of
    their id.  Rows without a label or id are left out; an id with both labels counts as 1.  At most
    ``selected`` buckets that tell alone are kept, and as many again that tell in pairs among ``paired``."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    some = hash_sample(known, "doc_id", max_rows)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    # at most max_rows rows of two numbers
    rows = _features(d.join(F.broadcast(some), "doc_id"), buckets).persist()
    counts = {r["label"]: (r["n"], r["c"].toArray()) for r in rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.numNonZeros(F.col("_hashed")).alias("c")).collect()}
    n0, n1 = (counts[k][0] if k in counts else 0 for k in (0, 1))
    machine, chosen = None, []
    if n0 and n1:
        chosen = sorted({*_choose(counts, min(selected, buckets)), *_interacting(rows, counts, paired, selected)})
        chosen = chosen or _choose(counts, FEW, 0.0)
    if chosen:
        data = VectorSlicer(inputCol="_hashed", outputCol="features", indices=chosen).transform(rows)
        machine = FMClassifier(featuresCol="features", labelCol="label", factorSize=factors, maxIter=iterations,
                               stepSize=step, regParam=1e-4, seed=1).fit(
            data.select("features", F.col("label").cast("double").alias("label")))
    rows.unpersist()
    return ToxicityModel(buckets, chosen, machine, n1 / (n0 + n1) if n0 + n1 else 0.0)


def reject(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the model does not call toxic, with all their columns."""
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    scored = model.score(d.select("row", F.col("row")[text_col].alias("text")), "row", "text")
    return scored.where("predicted = 0").select("doc_id.*")
