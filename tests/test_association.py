from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from lossgauge.operators import association as a
from lossgauge.operators import missing, texts


def frame_with_gaps(n=150, seed=4):
    random = np.random.default_rng(seed)
    frame = pd.DataFrame({"x": random.integers(0, 9, n).astype(float), "y": random.normal(size=n).round(1)})
    frame["z"] = (frame["x"] * 2 + random.normal(size=n) * 4).round()
    frame["w"] = -frame["y"]
    frame["flat"] = 3.0
    frame.loc[random.random(n) < 0.3, "y"] = np.nan
    frame.loc[random.random(n) < 0.2, "z"] = np.nan
    frame["same_gaps"] = frame["y"] ** 2
    return frame


def frame_to_df(spark, frame):
    kinds = ", ".join(f"{c} double" for c in frame.columns)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), kinds)


def spearman(one, other):
    known = one.notna() & other.notna()
    ranks = one[known].rank(), other[known].rank()
    if min(r.nunique() for r in ranks) < 2:
        return None
    return np.corrcoef(*ranks)[0, 1]


@pytest.mark.parametrize("limit", [7, 10**9])
def test_rank_correlation_equals_ranks_of_each_pair(spark, limit):
    frame = frame_with_gaps()
    found = {(r["a"], r["b"]): r["corr"] for r in a.rank_correlations(frame_to_df(spark, frame), group_limit=limit).collect()}
    assert len(found) == len(frame.columns) ** 2
    for one in frame:
        for other in frame:
            want = spearman(frame[one], frame[other])
            assert found[one, other] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_columns_without_gaps_need_one_ranking_each(spark):
    frame = frame_with_gaps()
    df = frame_to_df(spark, frame)
    full = a._rankings(df.select("x", "w", "flat"), ["x", "w", "flat"])
    assert set(full.values()) == {(c, c) for c in ("x", "w", "flat")}
    some = a._rankings(df.select("x", "y", "same_gaps"), ["x", "y", "same_gaps"])
    # x once whole and once where y and its like are known, which need no ranking for each other
    assert set(some.values()) == {("x", "x"), ("x", "y"), ("y", "y"), ("same_gaps", "same_gaps")}


def test_rank_correlation_counts_nan_as_unknown_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (2.0, 5.0), (3.0, None)], "x double, y double")
    found = {(r["a"], r["b"]): r["corr"] for r in a.rank_correlations(df).collect()}
    assert found["x", "y"] == pytest.approx(1.0)
    assert {r["corr"] for r in a.rank_correlations(df.limit(0)).collect()} == {None}


def test_ranks_are_joined_back_without_one_task_per_column(spark):
    plan = a.rank_correlations(frame_to_df(spark, frame_with_gaps()))._jdf.queryExecution().optimizedPlan().toString()
    # what is left above the stored ranks: one join, one regrouping by row, one row of sums
    assert plan.count("Join") == 1 and "Window" not in plan


def test_rows_are_ranked_without_being_taken_apart(spark):
    plan = a.rank_correlations(frame_to_df(spark, frame_with_gaps()))._jdf.queryExecution().optimizedPlan().toString()
    # one row of sums; nothing is grouped by row, and no row number is carried
    assert plan.count("Aggregate") == 1 and "_row" not in plan


def kendall(one, other):
    known = one.notna() & other.notna()
    x, y = one[known].to_numpy(), other[known].to_numpy()
    product = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    untied = [np.sum(v[:, None] != v) for v in (x, y)]
    return len(x), product.sum() / np.sqrt(untied[0] * untied[1]) if min(untied) else None


def test_inversions_equal_brute_force():
    random = np.random.default_rng(2)
    for _ in range(200):
        n = random.integers(0, 30)
        rank, weight, label = random.permutation(n), random.integers(1, 5, n).astype(float), random.integers(0, 3, n)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rank[i] > rank[j]]
        assert a.weighted_inversions(rank, weight) == sum(weight[i] * weight[j] for i, j in pairs)
        same = [(i, j) for i, j in pairs if label[i] == label[j]]
        assert a.weighted_inversions(rank, weight, label) == sum(weight[i] * weight[j] for i, j in same)


@pytest.mark.parametrize("limit", [40, 10**9])
def test_kendall_equals_all_pairs(spark, limit):
    frame = frame_with_gaps()
    found = a.kendall_correlations(frame_to_df(spark, frame), cell_limit=limit).collect()
    assert [(r["a"], r["b"]) for r in sorted(found, key=lambda r: list(combinations(frame, 2)).index((r["a"], r["b"])))] == list(
        combinations(frame, 2)
    )
    for r in found:
        n, tau = kendall(frame[r["a"]], frame[r["b"]])
        assert r["n"] == n and r["tau"] == (None if tau is None else pytest.approx(tau, abs=1e-12))


def test_kendall_of_a_column_that_is_nearly_all_one_value(spark):
    frame = pd.DataFrame({"x": [5.0] * 400 + list(range(100)), "y": [float(i * 37 % 101) for i in range(500)]})
    r = a.kendall_correlations(frame_to_df(spark, frame), cell_limit=50).first()
    assert (r["n"], r["tau"]) == (500, pytest.approx(kendall(frame["x"], frame["y"])[1], abs=1e-12))


def test_kendall_hands_no_large_block_to_one_task(spark, monkeypatch):
    cut, into_blocks = [], a.into_blocks
    monkeypatch.setattr(a, "into_blocks", lambda cells, keys, blocks: cut.append(blocks) or into_blocks(cells, keys, blocks))
    df = spark.range(300_000).selectExpr("double(id) AS x", "double(pmod(id * 7919, 300007)) AS y")
    frame = df.toPandas()
    order = np.argsort(np.argsort(frame["y"].to_numpy()))
    apart = a.weighted_inversions(order, np.ones(len(frame)))
    r = a.kendall_correlations(df).first()
    assert (r["n"], r["tau"]) == (300_000, pytest.approx(1 - 4 * apart / 300_000 / 299_999, abs=1e-12))
    # 300,000 cells of 200 bytes each are too much for one of several tasks of an executor
    assert cut and min(cut) >= 3


def test_kendall_without_rows(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert [tuple(r) for r in a.kendall_correlations(df).collect()] == [("x", "y", 0, None)]


def cramer(one, other):
    known = one.notna() & other.notna()
    table = pd.crosstab(one[known], other[known]).to_numpy().astype(float)
    n, (r, c) = table.sum(), table.shape
    chi2 = ((table - np.outer(table.sum(1), table.sum(0)) / n) ** 2 / (np.outer(table.sum(1), table.sum(0)) / n)).sum()
    phi = max(0.0, chi2 / n - (r - 1) * (c - 1) / (n - 1))
    return chi2, np.sqrt(phi / (min(r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)) - 1))


def test_cramers_v_equals_the_contingency_table(spark):
    random = np.random.default_rng(8)
    frame = pd.DataFrame({"k": random.choice(list("abcd"), 300), "m": random.choice(["u", "v", None], 300)}, dtype=object)
    frame["long"] = ["x" * 70 + v for v in frame["k"]]
    frame["many"] = [f"{i % 150}" for i in range(300)]
    frame["flat"], frame["none"], frame["own"] = "f", None, [f"{i}" for i in range(300)]
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} string" for c in frame))
    found = {(r["a"], r["b"]): r for r in a.text_association(df, list(frame)).collect()}
    for one, other in combinations(["k", "m", "long", "many"], 2):
        chi2, v = cramer(frame[one], frame[other])
        assert found[one, other]["chi2"] == pytest.approx(chi2) and found[one, other]["v"] == pytest.approx(v, abs=1e-9)
    assert found["k", "long"]["v"] == pytest.approx(1.0)
    assert {found["k", "flat"]["reason"], found["flat", "own"]["reason"]} == {"constant column"} and found["k", "flat"]["v"] is None
    assert (found["k", "none"]["n"], found["k", "none"]["reason"]) == (0, "no rows")


def test_cramers_v_without_room_for_the_correction(spark):
    df = spark.createDataFrame([(str(i), str(-i)) for i in range(40)], "x string, y string")
    r = a.text_association(df, ["x", "y"]).first()
    assert (r["v"], r["reason"]) == (None, "too few rows")


def brute_linkage(points):
    groups, merges = [[i] for i in range(len(points))], []
    while len(groups) > 1:
        best = min(
            (np.mean([points[i][j] for i in x for j in y]), min(x), min(y), x, y) for x, y in combinations(sorted(groups), 2)
        )
        merges.append((sorted(best[3]), sorted(best[4]), best[0]))
        groups = [g for g in groups if g not in best[3:]] + [best[3] + best[4]]
    return merges


def test_average_linkage_equals_brute_force():
    random = np.random.default_rng(6)
    for _ in range(60):
        n = int(random.integers(1, 8))
        points = random.random((n, n)) + 0.0
        points = points + points.T
        found = missing.average_linkage([points[i][j] for i, j in combinations(range(n), 2)], n)
        want = brute_linkage(points)
        assert [(x, y) for _, x, y, _ in found] == [(x, y) for x, y, _ in want]
        np.testing.assert_allclose([m[3] for m in found], [m[2] for m in want])


def test_missing_structure(spark, rows):
    frame = frame_with_gaps()
    df = frame_to_df(spark, frame)
    marks = frame.isna()
    want = Counter("".join("1" if v else "0" for v in row) for row in marks.to_numpy())
    found = missing.missing_patterns(df).collect()
    assert {r["pattern"]: r["n"] for r in found} == want
    assert all(r["n_missing"] == r["pattern"].count("1") and r["share"] == pytest.approx(r["n"] / len(frame)) for r in found)
    corr = {(r["a"], r["b"]): r["corr"] for r in missing.missing_correlation(df).collect()}
    assert corr["y", "same_gaps"] == pytest.approx(1.0) and corr["x", "y"] is None
    assert corr["z", "y"] == pytest.approx(np.corrcoef(marks["z"], marks["y"])[0, 1])
    merges = [tuple(r) for r in missing.missing_clusters(df).collect()]
    points = [[np.sqrt((marks[p] != marks[q]).sum()) for q in frame] for p in frame]
    names = list(frame.columns)
    assert [m[1:3] for m in merges] == [([names[i] for i in x], [names[i] for i in y]) for x, y, _ in brute_linkage(points)]
    assert missing.missing_patterns(df.limit(0)).count() == 0 and missing.missing_correlation(df.limit(0)).count() == 0


def test_patterns_are_counted_in_one_pass(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_tax", "l_discount")
    for found in (missing.missing_correlation(df), missing.missing_clusters(df)):
        assert found._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1


def test_texts(spark, monkeypatch):
    monkeypatch.setattr(texts, "CHARACTERS_AT_ONCE", 5)
    some = ["aéA 中", "", None, "Ω\n😀 7", "a" * 9, "x y z w"]
    df = spark.createDataFrame([(t, "b") for t in some], "t string, u string")
    found = texts.character_counts(df).collect()
    assert {r["character"]: r["n"] for r in found if r["column"] == "t"} == Counter("".join(t or "" for t in some))
    kinds = {r["character"]: (r["category"], r["script"]) for r in found}
    assert kinds["中"] == ("Lo", "Han") and kinds["Ω"] == ("Lu", "Greek") and kinds["\n"] == ("Cc", "Common")
    assert kinds["é"] == ("Ll", "Latin") and kinds["😀"] == ("So", "Common") and kinds["7"][0] == "Nd"
    scripts = {(r["column"], r["script"]): (r["characters"], r["n"]) for r in texts.script_counts(df).collect()}
    assert scripts["t", "Latin"] == (7, 16) and scripts["u", "Latin"] == (1, 6)
    lengths = {r["at_least"]: tuple(r)[2:] for r in texts.length_histogram(df, ["t"]).collect()}
    assert lengths == {0: (1, 0, 0), 4: (3, 17, 9), 8: (1, 9, 1)}


def test_no_row_per_character_is_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = texts.character_counts(docs, ["text"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.index("MapInArrow") and "Generate" not in plan
