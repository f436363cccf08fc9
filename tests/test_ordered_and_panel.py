import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossgauge.operators import ordered, panel


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows; one entity holds most of them; gaps of many lengths."""
    random = np.random.default_rng(3)
    n = 4000
    entity = np.where(random.random(n) < 0.7, "hot", random.choice(["a", "b", "c", None], n))
    frame = pd.DataFrame({"entity": entity, "position": random.permutation(n)})
    frame["x"] = np.where(random.random(n) < 0.1, random.integers(0, 50, n).astype(float), np.nan)
    frame["label"] = np.where(random.random(n) < 0.02, "t" + frame["position"].astype(str), None)
    schema = "entity string, position long, x double, label string"
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), schema)
    return frame, df.repartition(8)


def expected_fill(frame, across):
    ordered_frame = frame.sort_values(["entity", "position"], na_position="first").copy()
    columns = ["x", "label"]
    if across:
        ordered_frame[columns] = ordered_frame[columns].ffill()
    else:
        ordered_frame[columns] = ordered_frame.groupby("entity", dropna=False)[columns].ffill()
    cleaned = ordered_frame[["position", "x", "label"]].astype(object).where(ordered_frame.notna(), None)
    return sorted(map(tuple, cleaned.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("limit", [100, 10**9])
def test_fill_within_entities(skewed, rows, limit):
    frame, df = skewed
    filled = ordered.forward_fill(df, ["x", "label"], partition_by=["entity"], order_by=["position"], group_limit=limit)
    assert filled.columns == df.columns
    assert rows(filled, "position", "x", "label") == expected_fill(frame, across=False)


def test_fill_across_entities(skewed, rows):
    frame, df = skewed
    filled = ordered.forward_fill(df, ["x", "label"], order_by=["entity", "position"])
    assert rows(filled, "position", "x", "label") == expected_fill(frame, across=True)


def test_fill_is_idempotent(skewed, rows):
    _, df = skewed
    fill = lambda d: ordered.forward_fill(d, ["x"], partition_by=["entity"], order_by=["position"], group_limit=50)
    once = fill(df)
    assert rows(fill(once)) == rows(once)


def test_blocks_split_the_hot_group(skewed):
    _, df = skewed
    assert ordered.blocks_needed(df, ["entity"], 10**9) == 1
    needed = ordered.blocks_needed(df, ["entity"], 100)
    assert needed == 40
    sizes = ordered.into_blocks(df, ["entity", "position"], needed).groupBy(ordered.BLOCK).count().toPandas()
    assert len(sizes) > 20 and sizes["count"].max() < 400


@pytest.mark.parametrize("limit", [100, 10**9])
def test_running_total(skewed, rows, limit):
    frame, df = skewed
    ranked = ordered.running_total(df, partition_by=["entity"], order_by=["position"], name="r", group_limit=limit)
    want = frame.sort_values("position").groupby("entity", dropna=False).cumcount() + 1
    assert rows(ranked, "position", "r") == sorted(zip(frame.loc[want.index, "position"], want), key=repr)


@pytest.mark.parametrize("limit", [10, 10**9])
@pytest.mark.parametrize("method", ["linear", "hazen"])
def test_quantiles(spark, limit, method):
    random = np.random.default_rng(5)
    frame = pd.DataFrame({"g": random.choice(["a", "b"], 999, p=[0.9, 0.1]), "v": random.normal(size=999).round(2)})
    frame = pd.concat([frame, pd.DataFrame({"g": ["one", "two", "two"], "v": [4.0, 1.0, 2.0]})])
    probabilities = {"low": 0.25, "mid": 0.5, "high": 0.9}
    found = ordered.exact_quantiles(
        spark.createDataFrame(frame), by=["g"], value="v", probabilities=probabilities, method=method, group_limit=limit
    ).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        for name, p in probabilities.items():
            assert found.loc[g, name] == pytest.approx(np.quantile(part["v"], p, method=method))
        assert found.loc[g, "n"] == len(part)


def test_resample_takes_last_known_value_per_column(spark, rows):
    df = spark.createDataFrame(
        [("a", 2000, 1, 5.0, "x"), ("a", 2000, 2, None, "y"), ("a", 2003, 1, None, None), (None, 2000, 1, 1.0, "q")],
        "c string, y int, o int, v double, t string",
    )
    yearly = panel.resample_last(df, entity="c", year="y", order_by=["o"], columns=["v", "t"])
    assert rows(yearly) == [("a", 2000, 5.0, "y"), ("a", 2003, None, None)]
    dense = panel.densify_years(yearly, entity="c", year="y")
    assert rows(dense, "c", "y", "v") == [("a", 2000, 5.0), ("a", 2001, None), ("a", 2002, None), ("a", 2003, None)]


def test_densify_fill_and_measured_values(spark, rows):
    df = spark.createDataFrame(
        [("a", 2000, "k", 1.0, 7.0), ("a", 2002, "k", 2.0, 8.0), ("b", 2001, None, None, 9.0)],
        "c string, y int, item string, f double, m double",
    )
    measured = spark.createDataFrame(
        [("a", 2000, "k", 7.0), ("a", 2001, "k", 7.5), ("a", 2002, "j", 1.0), ("b", 2001, "k", 9.0)],
        "c string, y int, item string, m double",
    )
    arguments = dict(
        entity="c", year="y", order_by=["item"], columns=["item", "f", "m"], keys=["c", "y", "item"], measure="m"
    )
    within = panel.densify_and_reattach(df, measured, **arguments)
    assert rows(within, "c", "y", "item", "f", "m") == [("a", 2000, "k", 1.0, 7.0), ("a", 2001, "k", 1.0, 7.5)]
    across = panel.densify_and_reattach(df, measured, **arguments, fill_across=True)
    assert ("b", 2001, "k", 2.0, 9.0) in rows(across, "c", "y", "item", "f", "m")


def test_group_order_and_partitions_do_not_matter(spark, skewed, rows):
    _, df = skewed
    results = []
    for parts in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        filled = ordered.forward_fill(df, ["x"], partition_by=["entity"], order_by=["position"], group_limit=100)
        results.append(rows(filled))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_rename_of_block_column_is_not_visible(skewed):
    _, df = skewed
    assert ordered.BLOCK not in ordered.running_total(
        df.select("entity", "position", F.lit(2).alias("w")),
        partition_by=["entity"], order_by=["position"], weight="w", name="s", group_limit=1,
    ).columns
