import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lossgauge.operators import enrich, reshape


def test_dimension_join_drops_key_and_unknown_rows(spark, rows):
    fact = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "country string, v int")
    dim = spark.createDataFrame([("a", "east")], "Country2 string, Region string")
    joined = enrich.attach_dimension(fact, dim, "country", "Country2")
    assert joined.columns == ["country", "v", "Region"]
    assert rows(joined) == [("a", 1, "east")]


def test_dimension_join_with_same_key_name_in_other_case(spark, rows):
    fact = spark.createDataFrame([("a", 1)], "country string, v int")
    dim = spark.createDataFrame([("a", "east")], "Country string, Region string")
    joined = enrich.attach_dimension(fact, dim, "country", "Country")
    assert joined.columns == ["country", "v", "Region"]
    assert rows(joined) == [("a", 1, "east")]


def test_lookup_rename_misses_become_null_and_double_entries_do_not_multiply(spark, rows):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int")
    renames = spark.createDataFrame([("x", "X1"), ("x", "X2")], "old string, new string")
    assert rows(enrich.lookup_rename(df, "name", renames, "old", "new")) == [("X2", 1), (None, 2)]


def test_reattach_swaps_the_measure(spark, rows):
    dense = spark.createDataFrame([("a", 2000, 9.0), ("a", 2001, 9.0)], "c string, y int, m double")
    measured = spark.createDataFrame([("a", 2000, 5.0)], "c string, y int, m double")
    assert rows(enrich.reattach(dense, measured, ["c", "y"], "m")) == [("a", 2000, 5.0)]


def test_unpivot_keeps_null_and_pivot_rejects_double_cells(spark, rows):
    wide = spark.createDataFrame([("a", 1.0, None)], "k string, x double, y double")
    long = reshape.wide_to_long(wide, ["k"], None, "name", "value")
    assert rows(long) == [("a", "x", 1.0), ("a", "y", None)]
    twice = long.unionByName(long)
    with pytest.raises(Exception, match="more than one row"):
        reshape.long_to_wide(twice, ["k"], "name", "value", ["x", "y"]).collect()
    assert rows(reshape.long_to_wide(twice, ["k"], "name", "value", ["x", "y"], unique=False)) == [("a", 1.0, None)]


def test_stack_years(spark, rows):
    wide = spark.createDataFrame(
        [("a", "s1", "1", "2"), ("a", "s2", "3", ".."), ("b", "s1", "5", "6")], "c string, s string, `2007 [x]` string, `2010 [x]` string"
    )
    stacked = reshape.stack_years(
        wide, entity="c", series="s", years={"2007 [x]": 2007, "2010 [x]": 2010}, labels=["s1", "s2"]
    )
    assert stacked.columns == ["c", "year", "s1", "s2"]
    assert rows(stacked) == [("a", 2007, "1", "3"), ("a", 2010, "2", ".."), ("b", 2007, "5", None), ("b", 2010, "6", None)]


def test_one_hot(spark, rows):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(reshape.one_hot(df, "k", ["a", "b"])) == [(0, 0), (1, 0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 20), st.tuples(st.floats(-5, 5), st.floats(-5, 5)), min_size=1, max_size=12))
def test_pivot_after_unpivot_is_identity(spark, rows, table):
    wide = spark.createDataFrame([(k, x, y) for k, (x, y) in table.items()], "k long, x double, y double")
    long = reshape.wide_to_long(wide, ["k"], ["x", "y"], "name", "value")
    assert rows(reshape.long_to_wide(long, ["k"], "name", "value", ["x", "y"])) == rows(wide)


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, line = line, [i]
        for j, y in enumerate(b, 1):
            line.append(min(above[j] + 1, line[-1] + 1, above[j - 1] + (x != y)))
    return line[-1]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_suggestions_equal_all_comparisons(spark, most):
    random = np.random.default_rng(most)
    known = ["Peru", "Perú", "Chile", "China", "Iran", "Iraq", "Niger", "Nigeria", "", "a", "Ab"]
    lost = ["peru", "Pery", "Irax", "Nigerr", "Nigera", "Chiel", "b", "ba", "Zzzzzz", None, "Peru"]
    lost += ["".join(random.choice(list("abc"), random.integers(0, 6))) for _ in range(40)]
    known += ["".join(random.choice(list("abc"), random.integers(0, 6))) for _ in range(40)]
    left = spark.createDataFrame([(x, 1) for x in lost], "name string, n int")
    right = spark.createDataFrame([(x,) for x in known + [None, "Peru"]], "official string")
    found = enrich.suggest_names(left, right, "name", "official", most=most).collect()
    want = {(x, y, edits(x.lower(), y.lower())) for x in lost if x is not None for y in known}
    assert sorted(map(tuple, found)) == sorted(w for w in want if w[2] <= most)


def test_suggestions_form_no_pairs_of_all_names(spark):
    left = spark.createDataFrame([("a",)], "name string")
    right = spark.createDataFrame([("b",)], "official string")
    plan = enrich.suggest_names(left, right, "name", "official")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*\(_form#\d+ = _form#\d+\)", plan) and "Cross" not in plan
