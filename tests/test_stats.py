import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossgauge.functions import special
from lossgauge.operators import stats

FEATURES = ["a", "b", "c"]


def lstsq(part):
    x = part[FEATURES].to_numpy()
    y = part["y"].to_numpy()
    return np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]


def test_least_squares_with_every_kind_of_group(spark):
    random = np.random.default_rng(1)
    parts = []
    for name, n in {"full": 60, "short": 3, "pair": 2, "single": 1}.items():
        part = pd.DataFrame(random.normal(size=(n, 3)) * [1.0, 1000.0, 0.001], columns=FEATURES)
        parts.append(part.assign(g=name, y=part["a"] - part["b"] / 500 + random.normal(size=n)))
    double = pd.DataFrame(random.normal(size=(40, 3)), columns=FEATURES)
    double["c"] = 2 * double["a"]
    parts.append(double.assign(g="dependent", y=double["a"] + random.normal(size=40)))
    flat = pd.DataFrame(random.normal(size=(40, 3)), columns=FEATURES).assign(b=7.0)
    parts.append(flat.assign(g="constant", y=flat["a"] + random.normal(size=40)))
    frame = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(frame).unionByName(
        spark.createDataFrame([(None, 1.0, 1.0, "full", 100.0)], "a double, b double, c double, g string, y double")
    )
    fits = stats.fit_least_squares(df, by=["g"], target="y", features=FEATURES).toPandas().set_index("g")
    assert fits.loc["full", "n"] == 60
    for name, part in frame.groupby("g"):
        np.testing.assert_allclose(fits.loc[name, "coefficients"], lstsq(part), rtol=1e-6, atol=1e-9)
    assert list(fits.loc["single", "coefficients"]) == [0.0, 0.0, 0.0]
    coef = np.array(fits.loc["full", "coefficients"])
    part = frame[frame["g"] == "full"]
    centred = part[FEATURES] - part[FEATURES].mean()
    residual = (part["y"] - part["y"].mean()) - centred @ coef
    assert np.abs(centred.to_numpy().T @ residual).max() < 1e-6


def test_coefficient_rows_and_table(spark, rows):
    fits = spark.createDataFrame([("g", 5, [1.0, -2.0]), ("h", 6, [3.0, 4.0])], "g string, n long, coefficients array<double>")
    long = stats.coefficient_rows(fits, ["a", "b"])
    assert rows(long, "g", "feature", "coef") == [("g", "a", 1.0), ("g", "b", -2.0), ("h", "a", 3.0), ("h", "b", 4.0)]
    assert rows(stats.coefficient_table(long, "g", ["g", "h"])) == [("a", 1.0, 3.0), ("b", -2.0, 4.0)]


def brute_nearest(frame, features):
    groups = frame[frame["g"].notna() & (frame["g"] != "Nan")].groupby("g")[features].mean()
    found = {}
    for entity, part in frame.groupby("e"):
        gaps = (groups - part[features].mean()).sum(axis=1).abs()
        actual = part["g"].value_counts()
        actual = sorted(actual.items(), key=lambda t: (-t[1], t[0]))[0][0] if len(actual) else None
        found[entity] = (actual, gaps.sort_index().idxmin(), gaps.min())
    return found


@pytest.mark.parametrize("limit", [10, 10**9])
def test_nearest_group_against_brute_force(spark, limit):
    random = np.random.default_rng(2)
    n = 1500
    frame = pd.DataFrame(random.normal(size=(n, 3)), columns=FEATURES)
    frame["e"] = [f"e{v}" for v in random.integers(0, 120, n)]
    frame["g"] = random.choice(["g1", "g2", "g3", "g4", "Nan", None], n)
    frame.loc[frame["g"] == "g4", "b"] = np.nan
    frame.loc[frame["e"].isin(["e1", "e2", "e3"]), "a"] = np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, e string, g string")
    found = stats.nearest_group(df, entity="e", group="g", features=FEATURES, group_limit=limit).collect()
    want = brute_nearest(frame, FEATURES)
    assert {r["e"] for r in found} == set(want)
    for r in found:
        actual, nearest, distance = want[r["e"]]
        assert (r["actual_group"], r["nearest_group"]) == (actual, nearest)
        assert r["distance"] == pytest.approx(distance, abs=1e-9)
        assert r["is_equal"] == (actual == nearest)


def test_distribution_functions_against_commons_math(spark):
    math = spark._jvm.org.apache.commons.math3.distribution
    pairs = [(t, df) for t in (0.0, 0.3, 1.5, 2.2, 9.0, -4.0) for df in (1.0, 2.5, 7.3, 60.0, 2500.5, 250000.0)]
    own = special._student_two_sided(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    for value, (t, df) in zip(own, pairs):
        assert value == pytest.approx(2 * math.TDistribution(df).cumulativeProbability(-abs(t)), rel=1e-8, abs=1e-13)
    # that library loses digits for very large samples; there the normal tail and the first term of its expansion will do
    from statistics import NormalDist

    normal = NormalDist()
    pairs = [(t, df) for t in (0.3, 1.5, 2.2, 4.0) for df in (1e7, 1e9, 1e12)]
    own = special._student_two_sided(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    for value, (t, df) in zip(own, pairs):
        assert value == pytest.approx(2 * normal.cdf(-t) + normal.pdf(t) * (t**3 + t) / (2 * df), rel=1e-9)
    assert special._student_two_sided(pd.Series([1.959963984540054]), pd.Series([1e12]))[0] == pytest.approx(0.05, abs=1e-10)
    pairs = [(x, df) for x in (0.01, 0.9, 4.0, 30.0, 200.0) for df in (1.0, 3.0, 15.0, 45.0)]
    own = special._chi_square_upper(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    for value, (x, df) in zip(own, pairs):
        assert value == pytest.approx(1 - math.ChiSquaredDistribution(df).cumulativeProbability(x), rel=1e-7, abs=1e-13)


def test_normal_quantile(spark):
    from statistics import NormalDist

    points = [1e-300, 1e-20, 1e-6, 0.01, 0.07, 0.075, 0.3, 0.5, 0.9, 0.93, 0.999, 1 - 1e-12]
    df = special.with_normal_quantile(spark.createDataFrame([(p,) for p in points], "p double"), F.col("p"), "z")
    for r in df.collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-15)


def test_welch(spark):
    random = np.random.default_rng(4)
    frame = pd.DataFrame({"e": ["x"] * 6 + ["y"] * 9 + ["z"], "g": "all", "a": random.normal(size=16), "b": 1.0})
    df = spark.createDataFrame(frame)
    tests = stats.welch_tests(
        stats.sample_moments(df, "e", ["a", "b"]),
        stats.sample_moments(df, "g", ["a", "b"]),
        df.select("e", "g").distinct(),
        entity="e",
        group="g",
    ).toPandas().set_index(["e", "feature"])
    one, two = frame[frame["e"] == "x"]["a"], frame["a"]
    error = one.var() / len(one) + two.var() / len(two)
    t = (one.mean() - two.mean()) / np.sqrt(error)
    dof = error**2 / ((one.var() / 6) ** 2 / 5 + (two.var() / 16) ** 2 / 15)
    math = spark._jvm.org.apache.commons.math3.distribution
    row = tests.loc[("x", "a")]
    assert (row["statistic"], row["dof"]) == pytest.approx((t, dof))
    assert row["pval"] == pytest.approx(2 * math.TDistribution(float(dof)).cumulativeProbability(-abs(float(t))))
    assert row["significant"] == (row["pval"] < 0.05)
    assert tests.loc[("z", "a"), "reason"] == "fewer than 2 values"
    assert tests.loc[("x", "b"), "reason"] == "constant values"
    assert np.isnan(tests.loc[("x", "b"), "pval"])


def test_normality_published_sample_and_degenerate_ones(spark):
    weights = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    data = [("weights", float(v)) for v in weights]
    data += [("two", 1.0), ("two", 2.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("three", 1.0), ("three", 2.0), ("three", 3.0)]
    found = stats.normality_tests(spark.createDataFrame(data, "g string, v double"), by="g", features=["v"])
    found = found.toPandas().set_index("g")
    assert found.loc["weights", "statistic"] == pytest.approx(0.7888, abs=1e-4)
    assert found.loc["weights", "pval"] == pytest.approx(0.0067, abs=1e-4)
    assert not found.loc["weights", "normal"]
    assert found.loc["two", "reason"] == "fewer than 3 values"
    assert found.loc["flat", "reason"] == "constant values"
    assert found.loc["three", "statistic"] == pytest.approx(1.0)
    assert found.loc["three", "pval"] == pytest.approx(1.0)


# Published samples with their W and p: miles per gallon of 32 cars, heights of 15 women, first integers
CARS = (21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4)
PUBLISHED = {"cars": (CARS, 0.94756, 0.1229), "women": (range(58, 73), 0.96359, 0.7545), "five": (range(1, 6), 0.98676, 0.9672)}


def test_normality_of_published_samples(spark):
    data = [(name, float(v)) for name, (sample, _, _) in PUBLISHED.items() for v in sample] + [("three", v) for v in (1.0, 2.0, 4.0)]
    found = stats.normality_tests(spark.createDataFrame(data, "g string, v double"), by="g", features=["v"])
    found = {r["g"]: (r["statistic"], r["pval"]) for r in found.collect()}
    for name, (_, w, p) in PUBLISHED.items():
        assert found[name] == (pytest.approx(w, abs=2e-5), pytest.approx(p, abs=2e-4))
    # three values have a closed form: half the squared range over the squares about the mean
    w = 4.5 / (14 / 3)
    assert found["three"] == (pytest.approx(w), pytest.approx(6 / np.pi * (np.arcsin(w**0.5) - np.arcsin(0.75**0.5))))


def test_ranks_unfold_block_by_block(spark):
    df = spark.createDataFrame([("g", float(i % 3)) for i in range(50)], "g string, v double")
    plan = stats.normality_tests(df, by="g", features=["v"])._jdf.queryExecution().executedPlan().toString()
    unfolded = plan.index("Generate explode(sequence(lo")
    assert "_rank_block" in plan[unfolded:].split("Exchange hashpartitioning(")[1].split("\n")[0]


def test_normality_is_the_same_in_blocks_and_with_cut_runs(spark, monkeypatch):
    random = np.random.default_rng(8)
    frame = pd.DataFrame({"g": "g", "v": random.normal(size=800).round(1)})
    df = spark.createDataFrame(frame)
    plain = stats.normality_tests(df, by="g", features=["v"]).first()
    monkeypatch.setattr(stats, "RUN", 7)
    blocked = stats.normality_tests(df, by="g", features=["v"], group_limit=5).first()
    assert blocked["statistic"] == pytest.approx(plain["statistic"], rel=1e-12)
    assert blocked["pval"] == pytest.approx(plain["pval"], rel=1e-9)
    assert plain["statistic"] > 0.98


def test_correlations_with_gaps_and_constants(spark):
    random = np.random.default_rng(6)
    frame = pd.DataFrame(random.normal(size=(200, 3)), columns=FEATURES).assign(d=1.0)
    frame.loc[::3, "b"] = np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, d double")
    found = {(r["a"], r["b"]): r["corr"] for r in stats.correlations(df, [*FEATURES, "d"]).collect()}
    want = frame.corr()
    for x in FEATURES:
        for y in FEATURES:
            assert found[(x, y)] == pytest.approx(want.loc[x, y])
    assert found[("a", "d")] is None and found[("d", "d")] is None
    assert len(found) == 16


def test_one_hot_correlation_against_dummies(spark):
    random = np.random.default_rng(7)
    frame = pd.DataFrame({"k": random.choice(list("pqr"), 60), "m": random.normal(size=60), "o": random.normal(size=60)})
    frame.loc[::7, "m"] = np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "k string, m double, o double")
    found = {
        r["column"]: r["corr"]
        for r in stats.one_hot_correlation(df, category="k", measure="m", selected=["p", "q"], others=["o"]).collect()
    }
    chosen = frame[frame["k"].isin(["p", "q"])]
    want = pd.get_dummies(chosen, dtype=float).corr()["m"]
    assert found == {name: pytest.approx(value) for name, value in want.items()}
    nothing = stats.one_hot_correlation(df, category="k", measure="m", selected=[], others=["o"])
    assert nothing.count() == 0


def test_bartlett_and_adequacy(spark):
    random = np.random.default_rng(9)
    base = random.normal(size=(150, 1))
    x = base + random.normal(size=(150, 4))
    items = list("wxyz")
    frame = pd.DataFrame(x, columns=items).assign(g="g")
    same = frame.assign(g="same", x=frame["w"])
    df = spark.createDataFrame(pd.concat([frame, same]))
    r = np.corrcoef(x.T)
    inverse = np.linalg.inv(r)
    partial = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(4, dtype=bool)
    tested = stats.bartlett_sphericity(df, by=["g"], items=items).toPandas().set_index("g")
    statistic = -np.log(np.linalg.det(r)) * (150 - 1 - 13 / 6)
    assert tested.loc["g", "statistic"] == pytest.approx(statistic)
    assert tested.loc["g", "dof"] == 6
    assert 0 <= tested.loc["g", "pval"] < 1e-6
    assert np.isnan(tested.loc["same", "statistic"])
    measures = stats.sampling_adequacy(df, by=["g"], items=items).filter("g = 'g'").toPandas().set_index("item")["kmo"]
    overall = (r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum())
    assert measures["overall"] == pytest.approx(overall)
    first = (r[0, 1:] ** 2).sum() / ((r[0, 1:] ** 2).sum() + (partial[0, 1:] ** 2).sum())
    assert measures["w"] == pytest.approx(first)


def test_nearest_group_has_no_frame_that_shrinks(spark):
    rows = [(f"e{i}", f"g{i % 3}", float(i), None if i % 4 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "e string, g string, x double, y double")
    plan = stats.nearest_group(df, entity="e", group="g", features=["x", "y"])._jdf.queryExecution().optimizedPlan().toString()
    assert "last(found" in plan and "unboundedfollowing" not in plan.lower()


def nearly_dependent(n, seed, condition=1e10):
    """Three features of the given condition number about their means, and a target nearly on their plane."""
    random = np.random.default_rng(seed)
    left = np.linalg.qr(random.normal(size=(n, 3)) - 0.0)[0]
    left = np.linalg.qr(left - left.mean(axis=0))[0]
    right = np.linalg.qr(random.normal(size=(3, 3)))[0]
    x = left * [1.0, condition**-0.5, 1 / condition] @ right * n**0.5
    return pd.DataFrame(x, columns=FEATURES).assign(y=x @ [1.0, -2.0, 3.0] + random.normal(size=n) * 1e-13)


@pytest.mark.parametrize("fan", [2, 64])
def test_nearly_dependent_features_are_fitted_where_covariances_fail(spark, fan):
    parts = [nearly_dependent(n, n).assign(g=f"g{n}") for n in (200, 3000, 9000)]
    frame = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(frame).repartition(13)
    arguments = dict(by=["g"], target="y", features=FEATURES)
    found = stats.fit_nearly_dependent(df, **arguments, fan=fan).toPandas().set_index("g")
    squared = stats.fit_least_squares(df, **arguments).toPandas().set_index("g")
    for name, part in frame.groupby("g"):
        x, y = part[FEATURES].to_numpy(), part["y"].to_numpy()
        want = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]
        np.testing.assert_allclose(found.loc[name, "coefficients"], want, rtol=1e-3)
        assert found.loc[name, "n"] == len(part)
        assert np.abs(np.array(squared.loc[name, "coefficients"]) - want).max() > 0.1


def test_orthogonal_fits_equal_the_others_on_every_kind_of_group(spark, monkeypatch):
    monkeypatch.setattr(stats, "FACTORS_HELD", 2)
    random = np.random.default_rng(12)
    parts = [
        pd.DataFrame(random.normal(size=(n, 3)) * [1.0, 1e6, 1e-6], columns=FEATURES).assign(g=g, y=random.normal(size=n))
        for g, n in {"full": 90, "short": 3, "pair": 2, "single": 1}.items()
    ]
    double = pd.DataFrame(random.normal(size=(50, 3)) + 100, columns=FEATURES).assign(g="dependent", y=random.normal(size=50))
    double["c"] = 2 * double["a"] + 5
    flat = pd.DataFrame(random.normal(size=(50, 3)), columns=FEATURES).assign(b=7.3, g="constant", y=random.normal(size=50))
    frame = pd.concat([*parts, double, flat], ignore_index=True)
    df = spark.createDataFrame(frame).repartition(5)
    gaps = spark.createDataFrame([(None, 1.0, 1.0, "full", 9.0), (1.0, 1.0, 1.0, None, 9.0)], "a double, b double, c double, g string, y double")
    found = stats.fit_nearly_dependent(df.unionByName(gaps), by=["g"], target="y", features=FEATURES).toPandas().set_index("g")
    assert set(found.index) == set(frame["g"])
    for name, part in frame.groupby("g"):
        x, y = part[FEATURES].to_numpy(), part["y"].to_numpy()
        want = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=1e-15 if name == "full" else 1e-12)[0]
        if name in ("short", "pair"):
            # the smallest norm in the original units, whatever their scale
            fitted = (x - x.mean(axis=0)) @ np.array(found.loc[name, "coefficients"])
            np.testing.assert_allclose(fitted, y - y.mean(), atol=1e-8)
        np.testing.assert_allclose(found.loc[name, "coefficients"], want, rtol=1e-6, atol=1e-9)
    whole = stats.fit_nearly_dependent(df, by=[], target="y", features=["a"]).first()
    assert whole["n"] == len(frame) and whole["coefficients"][0] == pytest.approx(np.polyfit(frame["a"], frame["y"], 1)[0])
    assert stats.fit_nearly_dependent(df.limit(0), by=["g"], target="y", features=FEATURES).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 1024])
def test_moments_of_the_others_where_one_entity_holds_nearly_all_rows(spark, parts):
    random = np.random.default_rng(3)
    sizes = {"giant": 99_900, **{f"e{i}": 5 for i in range(20)}}
    frame = pd.concat(
        [pd.DataFrame({"e": e, "a": random.normal(size=n) + (50 if e == "giant" else i)}) for i, (e, n) in enumerate(sizes.items())]
    ).assign(g="all")
    alone = pd.DataFrame({"e": "alone", "a": [1.0, 2.0], "g": "own"})
    frame = pd.concat([frame, alone], ignore_index=True).assign(b=lambda f: f["a"].where(f["e"] != "e3"))
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "e string, a double, g string, b double")
    pairs = spark.createDataFrame([(e, "all") for e in (*sizes, "alone")] + [("alone", "own"), ("giant", "none")], "e string, g string")
    found = stats.moments_without(df, pairs, entity="e", group="g", features=["a", "b"], parts=parts).collect()
    assert len(found) == 2 * (len(sizes) + 2)
    for r in found:
        rest = frame[(frame["g"] == r["g"]) & (frame["e"] != r["e"])][r["feature"]].dropna()
        assert r["n"] == len(rest)
        if len(rest):
            assert r["mean"] == pytest.approx(rest.mean(), rel=1e-10) and r["variance"] == pytest.approx(rest.var(), rel=1e-10)
        else:
            assert r["mean"] is None and r["variance"] is None
