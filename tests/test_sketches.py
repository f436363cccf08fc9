import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossgauge.operators import sketches as sk

COLUMNS = ["v", "k", "t"]


@pytest.fixture(scope="module")
def table(spark):
    random = np.random.default_rng(7)
    n = 40_000
    frame = pd.DataFrame({"v": random.gamma(2, size=n) + 1e6, "k": random.zipf(1.4, n).clip(max=10**6)})
    frame["t"] = ["x" * 80 + str(i) if i % 5 else None for i in random.integers(0, 3000, n)]
    frame["part"] = random.integers(0, 6, n)
    kinds = "v double, k long, t string, part long"
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), kinds)
    return frame, df.repartition(6).cache()


def rows_of(df):
    return {r["column"]: r for r in df.collect()}


def test_profile_of_a_union_equals_a_fresh_one_within_the_promised_errors(table):
    frame, df = table
    states = sk.profile_states(df, COLUMNS, by=["part"])
    one, other = (sk.merge_states(states.where(F.col("part") % 2 == i)) for i in (0, 1))
    merged = sk.profile_of_states(sk.merge_states(one.unionByName(other)))
    found, fresh = rows_of(merged), rows_of(sk.profile_of_states(sk.profile_states(df, COLUMNS)))
    for c in COLUMNS:
        a, b = found[c], fresh[c]
        assert (a["rows"], a["n"], a["missing"]) == (b["rows"], b["n"], b["missing"]) == (
            len(frame), frame[c].notna().sum(), frame[c].isna().sum()
        )
        assert (a["lowest"], a["highest"]) == (b["lowest"], b["highest"])
        assert a["distinct_values"] == pytest.approx(b["distinct_values"], rel=2 * sk.DISTINCT_ERROR)
    for c in ("v", "k"):
        assert found[c]["mean"] == pytest.approx(frame[c].mean(), rel=1e-12)
        assert found[c]["deviation"] == pytest.approx(frame[c].std(), rel=1e-9)
    errors = rows_of(sk.measured_errors(df, merged))
    for c in COLUMNS:
        assert errors[c]["distinct_error"] <= sk.DISTINCT_ERROR
        assert errors[c]["quantile_error"] <= sk.QUANTILE_ERROR
        assert errors[c]["frequent_error"] <= sk.FREQUENT_ERROR
    want = frame["k"].value_counts()
    assert [x["value"] for x in found["k"]["frequent"][:3]] == [str(v) for v in want.index[:3]]


def test_states_keep_their_size_whatever_the_rows(table):
    _, df = table
    sizes = sk.profile_states(df, COLUMNS).select(*[F.octet_length(c).alias(c) for c in ("distinct", "quantiles")]).collect()
    assert max(r["distinct"] for r in sizes) < 2**sk.DISTINCT_BITS + 200 and max(r["quantiles"] for r in sizes) < 30_000


def test_measured_errors_see_a_wrong_profile(table):
    frame, df = table
    other = sk.profile_of_states(sk.profile_states(df.select((F.col("v") * 2).alias("v")), ["v"]))
    r = sk.measured_errors(df, other).first()
    assert r["quantile_error"] > 0.5


def test_empty_parts_and_null_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, "a")], "p int, v double, t string")
    states = sk.profile_states(df, ["v", "t"], by=["p"])
    found = rows_of(sk.profile_of_states(sk.merge_states(states)))
    assert (found["v"]["n"], found["v"]["mean"], found["v"]["p50"], found["v"]["deviation"]) == (1, 3.0, 3.0, None)
    assert found["t"]["p50"] is None and [tuple(x) for x in found["t"]["frequent"]] == [("a", 1)]
    assert sk.merge_states(states.limit(0)).count() == 0
    gaps = rows_of(sk.profile_of_states(states.where("p = 1")))
    assert gaps["v"]["distinct_values"] == 0 and gaps["t"]["frequent"] == []
