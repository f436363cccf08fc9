import pytest

from lossgauge.operators import decide


def choice(spark, n, coefficients, equal, actual, nearest):
    fits = [("e", 1, coefficients)] if coefficients else []
    fits = spark.createDataFrame(fits, "e string, n long, coefficients array<double>")
    comparison = spark.createDataFrame(
        [("e", n, "own group", "own group" if equal else "other", equal)],
        "e string, n long, actual_group string, nearest_group string, is_equal boolean",
    )
    counts = spark.createDataFrame([("e", actual, nearest)], "e string, actual_significant long, nearest_significant long")
    row = decide.select_model(fits, comparison, counts, entity="e").first()
    return row["chosen"], row["model_group"]


def test_every_branch_of_the_choice(spark):
    assert choice(spark, 6, [1.0, -2.0], False, 3, 0) == ("own", None)
    assert choice(spark, 5, [1.0, -2.0], True, 0, 0) == ("actual group", "own group")
    assert choice(spark, 5, [1.0, -2.0], False, 2, 2) == ("nearest group", "other")
    assert choice(spark, 5, [1.0, -2.0], False, 1, 2) == ("own", None)
    assert choice(spark, 50, [0.0, 0.0], True, 0, 0) == ("actual group", "own group")
    assert choice(spark, 3, [1.0, 1.0], False, None, None) == ("nearest group", "other")
    # no complete row, so no fit
    assert choice(spark, 50, None, True, 0, 0) == ("actual group", "own group")
    assert choice(spark, 50, None, False, 2, 1) == ("nearest group", "other")
    assert choice(spark, 50, None, False, 0, 1) == ("own", None)


def test_significant_counts_pass_over_missing_tests(spark, rows):
    tests = spark.createDataFrame(
        [("e", "actual group", True), ("e", "actual group", None), ("e", "nearest group", False)],
        "e string, role string, significant boolean",
    )
    assert rows(decide.significant_counts(tests, "e")) == [("e", 1, 0)]


def test_priorities_weights_and_catalogue(spark, rows):
    coefficients = spark.createDataFrame(
        [("e", "a", -1.0), ("e", "b", 0.0), ("e", "c", -3.0), ("e", "d", 2.0)], "e string, feature string, coef double"
    )
    ranked = decide.rank_priorities(coefficients, entity="e")
    assert rows(ranked, "feature", "weight", "priority") == [("a", 1, 2), ("c", 2, 1)]
    catalogue = spark.createDataFrame(
        [("a", "p1", 0.5, "good", None), ("a", "p2", 0.9, "good", "bad"), ("c", "p3", 0.1, None, None), ("x", "p4", 1.0, None, None)],
        "category string, policy string, loading double, benefits string, risks string",
    )
    for limit in (1, 10**9):
        shelf = decide.rank_catalogue(catalogue, category="category", item="policy", loading="loading", group_limit=limit)
        listed = decide.list_catalogue(ranked, shelf, entity="e", category="category")
        assert rows(listed, "label", "position", "policy") == [("1st", 1, "p3"), ("2nd", 1, "p2"), ("2nd", 2, "p1")]
        assert rows(decide.with_details(listed, ["benefits", "risks"]), "policy") == [("p2",)]
        assert decide.list_catalogue(ranked, shelf, entity="e", category="category", entities=["x"]).count() == 0
        short = decide.compact_list(ranked, shelf, entity="e", category="category")
        assert rows(short, "category", "label", "items") == [("a", "2nd", 2), ("c", "1st", 1)]


@pytest.mark.parametrize("limit", [1, 10**9])
def test_unknown_loadings_come_last(spark, rows, limit):
    items = [("a", "p1", None), ("a", "p2", 0.1), ("a", "p3", 0.9), ("a", "p0", None), ("b", "p4", None)]
    catalogue = spark.createDataFrame(items, "category string, policy string, loading double")
    shelf = decide.rank_catalogue(catalogue, category="category", item="policy", loading="loading", group_limit=limit)
    assert rows(shelf, "category", "position", "policy") == [("a", 1, "p3"), ("a", 2, "p2"), ("a", 3, "p0"), ("a", 4, "p1"), ("b", 1, "p4")]


@pytest.mark.parametrize("chosen, group, want", [("own", None, [("e", "a", 1.0)]), ("actual group", "g", [("e", "a", 9.0)]), ("nearest group", "x", [])])
def test_chosen_coefficients(spark, rows, chosen, group, want):
    selection = spark.createDataFrame([("e", chosen, group)], "e string, chosen string, model_group string")
    own = spark.createDataFrame([("e", [1.0])], "e string, coefficients array<double>")
    lent = spark.createDataFrame([("g", [9.0]), (None, [7.0])], "g string, coefficients array<double>")
    assert rows(decide.chosen_coefficients(selection, own, lent, entity="e", group="g", features=["a"])) == want
