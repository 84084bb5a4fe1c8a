import random
import zlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from hostgraph.llm import toxicity


def corpus(n=900, pairs=False):
    """Toxic: an insult; with pairs, only an insult beside a mention of a group."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        w = ["w%d" % rng.randrange(400) for _ in range(rng.randrange(5, 60))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        if insult:
            w.insert(rng.randrange(len(w)), rng.choice(["Moronix!", "scumbag,", "scumbags"]))
        if group:
            w.insert(rng.randrange(len(w)), rng.choice(["gnomes", "Elves"]))
        rows.append((i, " ".join(w), int(insult and (group or not pairs))))
    return rows


def scored(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t, _ in rows], "doc_id long, text string, score string, _hashed int")
    labels = spark.createDataFrame([(d, y, 1) for d, _, y in rows], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels, **more)
    return docs, model, model.score(docs).collect()


@pytest.mark.parametrize("pairs", [False, True])
def test_held_out_accuracy(spark, pairs):
    rows = corpus(pairs=pairs)
    _, _, got = scored(spark, rows)
    truth = {d: y for d, _, y in rows}
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert 100 < len(held) < 300
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_interactions_without_a_share_of_their_own(spark):
    """Toxic: an insult or a mention of a group, not both; each alone is half toxic, half not."""
    rng, rows = random.Random(9), []
    for i in range(2000):
        w = ["w%d" % rng.randrange(300) for _ in range(rng.randrange(5, 30))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["moronix"] * insult + ["gnomes"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(insult != group)))
    _, model, got = scored(spark, rows)
    truth = {d: y for d, _, y in rows}
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.95


def test_interacting_pairs_against_brute_force(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        x = [k for k in range(6) if rng.random() < 0.5]
        rows.append((i, x, int(((1 in x) != (4 in x)) ^ (rng.random() < 0.1))))
    frame = spark.createDataFrame([(d, y, Vectors.sparse(8, x, [1.0] * len(x))) for d, x, y in rows], StructType([StructField("doc_id", LongType()), StructField("label", IntegerType()), StructField("_hashed", VectorUDT())]))
    counts = {y: (sum(r[2] == y for r in rows), np.array([sum(r[2] == y and k in r[1] for r in rows) for k in range(8)], float)) for y in (0, 1)}
    share, want = counts[1][0] / len(rows), []
    for i in range(6):
        for j in range(i + 1, 6):
            cells = {(a, b): [r[2] for r in rows if (i in r[1]) == a and (j in r[1]) == b] for a in (0, 1) for b in (0, 1)}
            rate = {c: sum(v) / len(v) for c, v in cells.items()}
            d = rate[1, 1] - rate[1, 0] - rate[0, 1] + rate[0, 0]
            if d * d / (share * (1 - share) * sum(1 / len(v) for v in cells.values())) >= toxicity.LEAST_PAIR:
                want += [i, j]
    assert want == [1, 4]
    assert toxicity._interacting(frame, counts, 1024, 1024) == want


def test_no_telling_term(spark):
    """Labels by chance: scores still depend on the text."""
    rng = random.Random(3)
    rows = [(i, " ".join("w%d" % rng.randrange(50) for _ in range(8)), rng.randrange(2)) for i in range(200)]
    assert len({round(r.score, 9) for r in scored(spark, rows, iterations=20)[2]}) > 10


def test_held_out_labels_are_never_read(spark):
    rows = corpus(300)
    flipped = [(d, t, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, t, y in rows]
    a = {r.doc_id: r.score for r in scored(spark, rows, iterations=5)[2]}
    b = {r.doc_id: r.score for r in scored(spark, flipped, iterations=5)[2]}
    assert all(abs(a[d] - b[d]) < 1e-9 for d in a)
    ids = spark.createDataFrame([(d,) for d, _, _ in rows] + [(None,)], "doc_id long")
    for r in ids.select("doc_id", toxicity.held_out(ids.doc_id).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_edges(spark):
    rows = corpus(300)
    docs, model, _ = scored(spark, rows, iterations=30)
    odd = spark.createDataFrame([(1, None, "x", 0), (2, "", "x", 0), (None, "scumbag", "x", 0), (3, "w1 " * 20000, "x", 0),
                                 (3, "w1 " * 20000, "x", 0), (4, "a scumbag among the gnomes", "x", 0)], docs.schema)
    got = model.score(odd).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 3]
    assert model.score(odd.where("false")).count() == 0


@pytest.mark.parametrize("labels,rate", [([], 0.0), ([(d, 1) for d in range(20)], 1.0), ([(d, None) for d in range(20)], 0.0)])
def test_labels_of_one_kind_or_none(spark, labels, rate):
    docs = spark.createDataFrame([(d, "some text") for d in range(20)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.score for r in model.score(docs).collect()} == {rate}
