from pyspark.sql import functions as F

from lossgauge.functions import scalar
from lossgauge.operators import clean


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_deny_list_keeps_null_and_allow_list_does_not(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(clean.drop_values(df, "k", ["a"])) == [("b",), (None,)]
    assert rows(clean.keep_values(df, "k", ["a", "<NA>"])) == [("a",)]
    assert rows(clean.keep_listed(df, "k", spark.createDataFrame([("b",), ("b",)], "name string"), "name")) == [("b",)]
    assert rows(clean.drop_group(df, "k", "absent")) == rows(df)


def test_substring_and_pattern_treat_null_as_no_match(spark, rows):
    df = spark.createDataFrame([("x score",), ("x rank",), (None,)], "k string")
    assert rows(clean.keep_matching(df, "k", "score")) == [("x score",)]
    assert rows(clean.keep_matching(df, "k", "rank$", regex=True)) == [("x rank",)]


def test_duplicates_treat_null_as_equal(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2)], "a int, b int")
    assert rows(clean.drop_duplicate_rows(df)) == [(1, 2), (1, None)]


def test_filter_panel_ignores_all_and_accepts_nothing_selected(spark, rows):
    df = spark.createDataFrame([("a", 2000), ("b", 2001), ("a", 2005)], "k string, y int")
    assert rows(clean.filter_panel(df, equal={"k": "All"}, between={"y": (2000, 2001)})) == [("a", 2000), ("b", 2001)]
    assert rows(clean.filter_panel(df, equal={"k": "a"}, between={"y": (2001, 2005)})) == [("a", 2005)]
    assert rows(clean.filter_panel(df, member={"k": []})) == []


def test_markers_numbers_and_text(spark):
    assert one(spark, scalar.to_number(F.lit(".."))) is None
    assert one(spark, scalar.to_number(F.lit(" 3.5 "))) == 3.5
    assert one(spark, scalar.to_number(F.lit("abc"))) is None
    assert one(spark, scalar.to_number(F.lit("NaN"))) is None
    assert one(spark, scalar.blank_markers(F.lit("<NA>"))) is None
    assert one(spark, scalar.blank_markers(F.lit("Nan"))) == "Nan"
    assert one(spark, scalar.decimal_comma(F.lit("3,8"))) == 3.8
    assert one(spark, scalar.clean_text(F.lit("rich  "))) == "rich"
    assert one(spark, scalar.clean_text(F.lit("a b"))) == "a b"


def test_map_values_keeps_misses_and_null(spark):
    assert one(spark, scalar.map_values(F.lit("a"), {"a": "b", "b": "c"})) == "b"
    assert one(spark, scalar.map_values(F.lit("x"), {"a": "b"})) == "x"
    assert one(spark, scalar.map_values(F.lit(None).cast("string"), {"a": "b"})) is None
    assert one(spark, scalar.map_values(F.lit("x"), {})) == "x"


def test_labels_and_years(spark):
    labels = [one(spark, scalar.ordinal_label(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)]
    assert labels == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert one(spark, scalar.percent_label(F.lit(0.1225))) == "12.2%"
    assert one(spark, scalar.percent_label(F.lit(0.1235))) == "12.4%"
    assert one(spark, scalar.leading_year(F.lit("2007 [YR2007]"))) == 2007
    assert one(spark, scalar.year_end(F.lit(2010))).isoformat() == "2010-12-31"
    assert one(spark, scalar.first_item(F.array(F.lit("a"), F.lit("b")))) == "a"
    assert one(spark, scalar.first_item(F.array().cast("array<string>"))) is None


def test_sign_filters_nulls_and_casts(spark, rows):
    df = spark.createDataFrame([(1.0, "7"), (-2.0, "x"), (float("nan"), None)], "v double, t string")
    assert rows(clean.keep_positive(clean.nulls_for_nan(df), "v"), "v") == [(1.0,)]
    assert rows(clean.keep_negative(df, "v"), "v") == [(-2.0,)]
    assert rows(clean.nulls_for_nan(df), "v") == [(-2.0,), (1.0,), (None,)]
    assert rows(clean.cast_columns(df, {"t": "int"}), "t") == [(7,), (None,), (None,)]
    assert rows(clean.drop_incomplete(clean.nulls_for_nan(df)), "t") == [("7",), ("x",)]
    assert clean.rename_all(df, ["a", "b"]).columns == ["a", "b"]
