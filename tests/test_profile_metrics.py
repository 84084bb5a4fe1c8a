import pytest

from hostgraph.operators import metrics as M
from hostgraph.operators import profile as PR

RAW = "row_id long, src string, bytes double, label string, source_file string, capture_pos long"
DATA = ["row_id", "src", "bytes"]


def _raw(spark):
    rows = [(1, "a", 1.0, "BENIGN", "f1", 0), (None, None, None, None, "f1", 1), (None, None, float("nan"), "X", "f1", 2),
            (2, "b", float("inf"), "Web Attack \x96 XSS", "f1", 3), (3, "a", 1.0, "BENIGN", "f2", 0),
            (3, "a", 1.0, "BENIGN", "f2", 1), (None, None, None, None, "f2", 5)]
    return spark.createDataFrame(rows, RAW)


def test_blank_profile_contiguity(spark):
    got = {r.source_file: (r.n_rows, r.n_blank, r.first_blank_pos, r.last_blank_pos, r.blank_contiguous)
           for r in PR.profile_blank_rows(_raw(spark), DATA).collect()}
    assert got["f1"] == (4, 2, 1, 2, True)
    assert got["f2"] == (3, 1, 5, 5, True)


def test_duplicates_counted_on_real_rows(spark):
    got = {r.source_file: (r.n_real, r.n_duplicates) for r in PR.profile_duplicates(_raw(spark), DATA).collect()}
    assert got == {"f1": (2, 0), "f2": (2, 1)}


def test_duplicates_nan_and_null_compare_equal(spark):
    rows = [(None, "a", float("nan"), "L", "f", 0), (None, "a", float("nan"), "L", "f", 1)]
    got = PR.profile_duplicates(spark.createDataFrame(rows, RAW), DATA).first()
    assert got.n_duplicates == 1


def test_bad_labels_and_inf(spark):
    bad = PR.profile_bad_labels(_raw(spark), DATA).collect()
    assert [(r.source_file, r.n) for r in bad] == [("f1", 1)]
    inf = {r.source_file: (r.n_inf, r.n_missing) for r in PR.profile_inf_missing(_raw(spark), DATA).collect()}
    assert inf["f1"] == (1, 0) and inf["f2"] == (0, 0)


def test_totals(spark):
    r = PR.profile_totals(_raw(spark), DATA).first()
    assert (r.n_raw, r.n_blank, r.n_real, r.n_duplicates) == (7, 3, 4, 1)
    assert r.duplicate_rate == pytest.approx(0.25)


def test_label_distribution_levels(spark):
    got = {(r.source_file, r.label, r.grouping_level): r.n for r in PR.label_distribution(_raw(spark), DATA).collect()}
    assert got[("f2", "BENIGN", 0)] == 2 and got[(None, "BENIGN", 2)] == 3


def _pred(spark, pairs):
    return spark.createDataFrame(pairs, "y int, pred int")


def test_f1_binary(spark):
    r = M.f1_binary(_pred(spark, [(1, 1), (1, 1), (1, 0), (0, 1), (0, 0)])).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1)
    assert r.f1 == pytest.approx(2 / 3)


def test_f1_zero_division_is_zero(spark):
    assert M.f1_binary(_pred(spark, [(0, 0), (0, 0)])).first().f1 == 0.0


def test_classification_report_includes_predicted_only_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "t string, p string")
    rep = {r["class"]: r for r in M.classification_report(df, "t", "p").collect()}
    assert rep["c"].support == 0 and rep["c"].precision == 0.0
    assert rep["a"].precision == 1.0 and rep["a"].recall == 0.5
    assert rep["accuracy"].f1 == pytest.approx(0.5)
    assert rep["macro avg"].recall == pytest.approx((0.5 + 0.5 + 0.0) / 3)


def test_recall_per_class_benign_is_one_minus_fpr(spark):
    df = spark.createDataFrame([("BENIGN", 1), ("BENIGN", 0), ("BENIGN", 0), ("DDoS", 1)], "label string, pred int")
    got = {r.label: r.recall for r in M.recall_per_class(df).collect()}
    assert got["BENIGN"] == pytest.approx(2 / 3) and got["DDoS"] == 1.0
    assert M.benign_fpr(df).first().fpr == pytest.approx(1 / 3)
