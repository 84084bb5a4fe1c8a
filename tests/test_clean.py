import pytest

from hostgraph.operators import clean as CL

NAN, INF = float("nan"), float("inf")


def rows(spark):
    data = [("h1", 7.5, 3, "BENIGN", "f"), (None, None, None, "BENIGN", "f"), (None, NAN, None, None, "f"),
            ("h2", None, None, "Worm", "f"), (None, -INF, None, "Worm", "f"), (None, None, 0, None, None)]
    return spark.createDataFrame(data, "host string, rate double, port int, label string, source_file string")


def test_only_rows_without_any_value_are_dropped(spark):
    """Neither the label nor the provenance makes a row; NaN counts as missing."""
    got = CL.drop_blank_rows(rows(spark)).collect()
    assert [(r.host, r.rate, r.port) for r in got] == [("h1", 7.5, 3), ("h2", None, None), (None, -INF, None), (None, None, 0)]


def test_labels_lose_the_misread_dash_and_outer_blanks(spark):
    labels = ["Port \x96 Scan", "\n Worm\t", "a\x96b\x96c ", "plain", None, "  "]
    df = spark.createDataFrame(list(enumerate(labels)), "k int, label string")
    got = [r.label for r in CL.fix_label_encoding(df).orderBy("k").collect()]
    assert got == ["Port - Scan", "Worm", "a-b-c", "plain", None, ""]


def test_infinite_and_undefined_numbers_become_null(spark):
    df = spark.createDataFrame([(0, -2.25, "Infinity"), (1, INF, "x"), (2, -INF, "NaN"), (3, NAN, ""), (4, None, "y")],
                               "k int, v double, s string")
    got = CL.coerce_inf(df).orderBy("k").collect()
    assert [r.v for r in got] == [-2.25, None, None, None, None]
    assert [r.s for r in got] == ["Infinity", "x", "NaN", "", "y"]


def test_weekday_of_every_capture_file(spark):
    df = spark.createDataFrame([(f,) for f in CL.FILE_TO_DAY], "source_file string")
    got = {r.source_file: r.day for r in CL.tag_source_day(df).collect()}
    assert got == CL.FILE_TO_DAY and len(got) == 10
    assert all(f.startswith(d) for f, d in got.items())


@pytest.mark.parametrize("name", ["other.csv", "", None])
def test_an_unknown_file_fails(spark, name):
    df = spark.createDataFrame([(name,)], "source_file string")
    with pytest.raises(Exception, match="unknown source file"):
        CL.tag_source_day(df).collect()
