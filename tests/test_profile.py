import numpy as np
import pandas as pd
import pytest

from lossgauge.operators import profile


@pytest.fixture(scope="module")
def table(spark):
    random = np.random.default_rng(11)
    frame = pd.DataFrame({"v": random.gamma(2, size=300).round(2), "k": random.choice(list("abc"), 300)})
    frame.loc[::10, "v"] = np.nan
    frame["t"] = "x" * 100 + frame["k"]
    return frame, spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "v double, k string, t string")


@pytest.mark.parametrize("limit", [20, 10**9])
def test_numeric(table, limit):
    frame, df = table
    row = profile.profile_numeric(df, group_limit=limit).first()
    v = frame["v"].dropna()
    assert (row["n"], row["missing"]) == (len(v), 30)
    assert row["mean"] == pytest.approx(v.mean())
    assert row["deviation"] == pytest.approx(v.std())
    assert row["skewness"] == pytest.approx(v.skew())
    assert row["kurtosis"] == pytest.approx(v.kurt())
    assert [row[q] for q in profile.QUANTILES] == pytest.approx(list(v.quantile(list(profile.QUANTILES.values()))))


def test_columns_and_frequent_values(table, rows):
    frame, df = table
    found = {r["column"]: r for r in profile.profile_columns(df).collect()}
    v = frame["v"]
    assert (found["v"]["distinct_values"], found["v"]["missing"]) == (v.nunique(), 30)
    assert found["v"]["unique_values"] == int((v.value_counts() == 1).sum())
    assert found["t"]["distinct_values"] == 3
    assert found["k"]["type"] == "string"
    top = [r for r in profile.profile_frequent(df, ["k", "v"], top=2).collect() if r["column"] == "k"]
    want = frame["k"].value_counts()
    assert sorted((r["position"], r["n"]) for r in top) == [(1, want.iloc[0]), (2, want.iloc[1])]


def test_histogram_and_duplicates(table, spark, rows):
    frame, df = table
    bars = profile.profile_histogram(df, ["v"], bins=8).toPandas().sort_values("bin")
    want, _ = np.histogram(frame["v"].dropna(), bins=8)
    assert bars.set_index("bin")["n"].reindex(range(8), fill_value=0).tolist() == want.tolist()
    twice = spark.createDataFrame([("y" * 80, 1), ("y" * 80, 1), ("y" * 80, 1), (None, 2)], "t string, n int")
    assert rows(profile.profile_duplicates(twice)) == [(4, 2, 0.5)]
    assert rows(profile.duplicate_rows(twice), "copies") == [(3,)]
