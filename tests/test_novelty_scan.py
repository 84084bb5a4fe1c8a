import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from hostgraph.operators.novelty import flow_novelty, flow_novelty_both
from hostgraph.operators.scan import running_count

SCHEMA = "row_id long, src string, dst string, ts timestamp_ntz"


def t(m):
    return dt.datetime(2017, 7, 6, 10, m)


def test_chronological_not_row_order(spark):
    df = spark.createDataFrame([(0, "A", "X", t(5)), (1, "A", "X", t(0))], SCHEMA)
    got = {r.row_id: r.novel_dst_for_src for r in flow_novelty(df).collect()}
    assert got == {0: False, 1: True}


def test_independent_sources(spark):
    df = spark.createDataFrame([(0, "A", "X", t(0)), (1, "B", "X", t(1))], SCHEMA)
    assert all(r.novel_dst_for_src for r in flow_novelty(df).collect())


def test_repeats_and_one_new(spark):
    rows = [(i, "A", "X", t(i % 50)) for i in range(20)] + [(20, "A", "Y", t(30))]
    got = flow_novelty(spark.createDataFrame(rows, SCHEMA)).where("novel_dst_for_src").count()
    assert got == 2


def test_ties_broken_by_row_id(spark):
    df = spark.createDataFrame([(5, "A", "X", t(0)), (3, "A", "X", t(0))], SCHEMA)
    got = {r.row_id: r.novel_dst_for_src for r in flow_novelty(df).collect()}
    assert got == {3: True, 5: False}


def test_reverse_flag_equals_forward(spark):
    rows = [(i, f"h{i % 3}", f"h{i % 5}", t(i % 60)) for i in range(40)]
    out = flow_novelty_both(spark.createDataFrame(rows, SCHEMA))
    assert out.where(F.col("novel_dst_for_src") != F.col("novel_src_for_dst")).count() == 0


def test_running_count_matches_window(spark):
    rng = random.Random(0)
    rows = [(i, rng.random() < 0.3, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, f boolean, k int")
    got = running_count(df, "f", ["k", "id"], "c", chunks=7)
    w = Window.orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("r", F.sum(F.col("f").cast("int")).over(w))
    assert got.join(ref, "id").where(F.col("c") != F.col("r")).count() == 0
    assert got.count() == 500


def test_exact_quantiles_match_linear_interpolation(spark):
    import numpy as np
    from hostgraph.operators.scan import exact_quantiles
    rng = random.Random(1)
    rows = [(g, float(rng.randint(0, 30)), i) for i in range(700) for g in (["a", "b", "c"][i % 3],)]
    rows += [("d", 5.0, 10_000)]
    df = spark.createDataFrame(rows, "g string, v double, k long")
    got = {(r.g, r.q): r.quantile for r in exact_quantiles(df, "g", "v", ["k"], chunks=5).collect()}
    for g in "abcd":
        vals = np.array([v for gg, v, _ in rows if gg == g])
        for q in (0.25, 0.5, 0.75):
            assert abs(got[(g, q)] - np.quantile(vals, q)) < 1e-12


def test_running_count_of_numbers_adds_them(spark):
    df = spark.createDataFrame([(1, 3), (2, 0), (3, 5_000_000_000), (4, 2)], "id long, n long")
    got = {r.id: r.c for r in running_count(df, "n", ["id"], "c", chunks=2).collect()}
    assert got == {1: 3, 2: 3, 3: 5_000_000_003, 4: 5_000_000_005}


def test_exact_quantiles_rank_each_distinct_value_once(spark, monkeypatch):
    import numpy as np
    from hostgraph.operators import scan
    sizes, count = [], scan.running_count
    monkeypatch.setattr(scan, "running_count", lambda df, *a: sizes.append(df.count()) or count(df, *a))
    rows = [("a", float(i % 4), i) for i in range(401)] + [("a", None, 500), ("b", 7.0, 501), ("b", 9.0, 501), ("c", None, 502),
                                                            (None, 3.0, 503)]
    df = spark.createDataFrame(rows, "g string, v double, k long").repartition(3)
    got = {(r.g, r.q): r.quantile for r in scan.exact_quantiles(df, "g", "v", ["k"], (0.0, 0.1, 0.5, 1.0)).collect()}
    assert sizes == [4 + 2 + 1]         # not one row per row
    assert got == {(g, q): float(np.quantile([v for h, v, _ in rows if h == g and v is not None], q))
                   for g in "ab" for q in (0.0, 0.1, 0.5, 1.0)}
