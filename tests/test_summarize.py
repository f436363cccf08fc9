import numpy as np
import pytest

from lossgauge.operators import summarize


def test_means_and_counts_drop_null_keys(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), (None, 5.0, 3)], "k string, v double, w int")
    assert rows(summarize.mean_by(df, ["k"])) == [("a", 1.0, 1.5)]
    assert rows(summarize.count_by(df, ["k"])) == [("a", 1, 2)]


def test_top_with_others_sums_to_total(spark, rows):
    data = [(f"v{i}",) for i in range(10) for _ in range(10 - i)] + [(None,)]
    df = spark.createDataFrame(data, "k string")
    found = summarize.top_with_others(df, "k").toPandas().set_index("k")
    assert list(found.index)[-1] == "Others" or "Others" in found.index
    assert found["n"].sum() == 55
    assert found.loc["Others", "n"] == 6
    assert found["share"].sum() == pytest.approx(1)
    assert found.loc["v0", "percent"] == "18.2%"


def test_top_without_rest_has_no_others_row(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert rows(summarize.top_with_others(df, "k"), "k", "n") == [("a", 2), ("b", 1)]


def test_mode_takes_smallest_on_tie(spark, rows):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "z"), ("h", None)], "g string, v string")
    assert rows(summarize.mode_by(df, ["g"], "v")) == [("g", "a"), ("h", "z")]


def test_distinct_values_and_ends(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, y int")
    assert rows(summarize.distinct_values(df, ["k", "y"])) == [("k", "a"), ("y", "1"), ("y", "2")]
    assert rows(summarize.min_max(df, ["y"])) == [("y", 1.0, 2.0)]


def test_scaling_sets_constant_columns_to_zero(spark, rows):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "a double, b double")
    assert rows(summarize.scale_min_max(df, ["a", "b"])) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


def test_row_maximum_skips_zero_and_null(spark, rows):
    df = spark.createDataFrame([(0.0, -1.0), (None, 0.0), (2.0, 3.0)], "a double, b double")
    assert rows(summarize.row_max_ignoring_zero(df, ["a", "b"], "m"), "m") == [(-1.0,), (3.0,), (None,)]


def test_histogram_totals(spark, rows):
    df = spark.createDataFrame([("r", 2000, 3), ("r", 2002, 4), ("s", 2002, 5), ("s", None, 9)], "c string, y int, n int")
    assert rows(summarize.histogram_sum(df, x="y", y="n", colour="c"), "c", "bin", "bin_start", "total") == [
        ("r", 0, 2000.0, 3),
        ("r", 2, 2002.0, 4),
        ("s", 2, 2002.0, 5),
    ]
    halves = summarize.histogram_sum(df, x="y", y="n", colour="c", bins=2)
    assert rows(halves, "c", "bin", "total") == [("r", 0, 3), ("r", 1, 4), ("s", 1, 5)]


@pytest.mark.parametrize("limit", [5, 10**9])
def test_box_plot(spark, limit):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 30.0, -25.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    box = summarize.box_plot(df, "g", "v", group_limit=limit).first()
    low, mid, high = np.quantile(values, [0.25, 0.5, 0.75], method="hazen")
    assert (box["q1"], box["median"], box["q3"]) == pytest.approx((low, mid, high))
    assert (box["lower_whisker"], box["upper_whisker"], box["outliers"], box["n"]) == (1.0, 10.0, 2, 12)
    points = summarize.box_plot_outliers(df, "g", "v", summarize.box_plot(df, "g", "v"))
    assert sorted(r["v"] for r in points.collect()) == [-25.0, 30.0]
