import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossgauge.plans import labels, policy_ranking
from lossgauge.plans.indicator_explorer import IndicatorExplorer, prepare_indicators
from lossgauge.plans.loss_explorer import LossExplorer, prepare_losses
from lossgauge.session import stable

COUNTRIES = ["Tanzania", "Vietnam", "Iran", "Laos", "Norway", "Peru"]
INCOMES = ["LOW-INCOME ECONOMIES ($1,085 OR LESS) ", "HIGH-INCOME ECONOMIES ($13,205 OR MORE) ", "Nan"]
OLD = {new: old for old, new in labels.COUNTRY_NAMES.items()}
SCORES = list(labels.SCORE_CATEGORIES)


@pytest.fixture(scope="module")
def tables(spark):
    random = np.random.default_rng(12)
    losses = []
    for c in COUNTRIES:
        for year in range(2005, 2019):
            for item in ("maize", "wheat, soft"):
                losses.append((7, OLD.get(c, c), year, item, float(random.uniform(1, 9)), "Storage", "Survey"))
    losses += losses[:5]
    losses += [(7, "Africa", 2007, "maize", 99.0, "Storage", "Survey"), (7, "Peru", 2007, "maize", 50.0, None, "Model")]
    losses = spark.createDataFrame(
        losses,
        "m49_code int, country string, year int, commodity string, loss_percentage double, food_supply_stage string, method_data_collection string",
    )
    series = [*SCORES, labels.OVERALL_SCORE, *labels.RANK_SERIES]
    wide = []
    for k, c in enumerate(COUNTRIES):
        for s in series:
            cells = [f"{random.uniform(1, 5):.3f}" for _ in labels.YEAR_COLUMNS]
            if k == 0 and s == SCORES[0]:
                cells[1] = ".."
            wide.append((f"{c}, Rep.", s, *cells))
    wide.append(("Nowhere", SCORES[0], *["1"] * 6))
    names = ", ".join(f"`{c}` string" for c in labels.YEAR_COLUMNS)
    indicators = spark.createDataFrame(wide, f"`Country Name` string, `Series Name` string, {names}")
    renames = spark.createDataFrame([(f"{c}, Rep.", c) for c in COUNTRIES], "`LPI Countries` string, `Country Name` string")
    entities = spark.createDataFrame(
        [(c, ["SOUTH ASIA", "NORTH AMERICA"][k % 2], INCOMES[k % 3]) for k, c in enumerate(COUNTRIES)],
        "Country string, Region string, Income string",
    )
    commodities = spark.createDataFrame(
        [("maize", "Cereals"), ("wheat, soft", "Cereals")], "Commodities string, `Commodity Groups` string"
    )
    return policy_ranking.Inputs(losses, indicators, renames, entities, commodities)


def test_panel_and_ranking(spark, tables, rows):
    panel = stable(policy_ranking.build_panel(tables))
    found = panel.toPandas()
    # densified to every year of 2007..2018, one commodity per year carried forward
    assert len(found) == len(COUNTRIES) * 12
    assert set(found["Income"]) == {"Low-Income Economies", "High-Income Economies", "Nan"}
    tracking = found[(found["country"] == "Tanzania") & found["year"].isin([2007, 2010])]["Tracking and Tracing"]
    assert tracking.nunique() == 1  # the marker was filled from 2007
    measured = tables.losses.toPandas()
    row = found[(found["country"] == "Peru") & (found["year"] == 2013)].iloc[0]
    same = measured[(measured["country"] == "Peru") & (measured["year"] == 2013) & (measured["commodity"] == "wheat, soft")]
    assert row["loss_percentage"] == pytest.approx(same["loss_percentage"].mean())

    ranking = policy_ranking.rank_categories(panel)
    features = list(labels.SCORE_CATEGORIES.values())
    selection = {r["country"]: r for r in ranking.selection.collect()}
    assert set(selection) == set(COUNTRIES)
    assert all(r["chosen"] == "own" for r in selection.values())
    assert "Nan" not in {r["nearest_group"] for r in selection.values()}
    part = found[found["country"] == "Norway"]
    x = part[features].to_numpy()
    coef = np.linalg.lstsq(x - x.mean(axis=0), part["loss_percentage"] - part["loss_percentage"].mean(), rcond=None)[0]
    want = [f for c, f in sorted(zip(coef, features)) if c < 0]
    mine = ranking.priorities.filter("country = 'Norway'").orderBy("priority")
    assert [r["feature"] for r in mine.collect()] == want

    catalogue = spark.createDataFrame(
        [(f"policy {i} of {f}", f, float(i)) for f in features for i in range(3)],
        "Policy string, `LPI-category` string, factor_loadings double",
    )
    listed = policy_ranking.list_policies(ranking.priorities, catalogue)
    mine = listed.filter("country = 'Norway'").orderBy("priority", "position").collect()
    assert [r["Policy"] for r in mine] == [f"policy {i} of {f}" for f in want for i in (2, 1, 0)]
    assert mine[0]["label"] == "1st"


def test_weak_entities_borrow_a_model(spark, tables):
    panel = stable(policy_ranking.build_panel(tables))
    lent = policy_ranking.rank_categories(panel, few=1000).selection.collect()
    assert {r["chosen"] for r in lent} <= {"actual group", "nearest group", "own"}
    for r in lent:
        if r["actual_group"] == r["nearest_group"]:
            assert r["chosen"] == "actual group" and r["model_group"] == r["actual_group"]


def test_loss_explorer(tables, rows):
    prepared = stable(prepare_losses(tables.losses, tables.entities, tables.commodities))
    assert prepared.count() == len(COUNTRIES) * 14 * 2 + 1
    assert prepared.filter("food_supply_stage is null").count() == 0
    assert {r[0] for r in rows(prepared.select("Region").distinct())} == {"South Asia", "North America"}
    explorer = LossExplorer(prepared).choose(years=(2007, 2010), country="All", commodity="maize")
    frame = prepared.toPandas()
    chosen = frame[frame["year"].between(2007, 2010) & (frame["commodity"] == "maize")]
    means = chosen.groupby("country")["loss_percentage"].mean()
    assert {r["country"]: r["loss_percentage"] for r in explorer.map_means().collect()} == pytest.approx(means.to_dict())
    assert explorer.year_means().count() == 4
    assert dict(rows(explorer.frequencies("country"), "country", "n")) == chosen["country"].value_counts().to_dict()
    picked = ["Peru", "Iran"]
    two = chosen[chosen["country"].isin(picked)].groupby(["country", "year"])[["loss_percentage"]].mean().reset_index()
    want = pd.get_dummies(two.drop(columns="year"), dtype=float).corr()["loss_percentage"]
    found = {r["column"]: r["corr"] for r in explorer.correlation("country", picked).collect()}
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    assert explorer.category_year_counts("country", picked).count() == 8
    assert explorer.histogram("country", picked).agg(F.sum("total")).first()[0] == 9
    assert explorer.correlation("country", []).count() == 0
    assert explorer.choose(country="Atlantis").map_means().count() == 0
    assert ("commodity", "maize") in rows(explorer.menus(["commodity", "Region"]))
    assert rows(explorer.year_range()) == [("year", 2007.0, 2010.0)]
    assert explorer.bars("Income").filter("Income = 'Nan'").count() == 0
    assert explorer.profile()["columns"].count() == len(prepared.columns)


def test_two_old_names_fill_alike_in_blocks(spark, tables, monkeypatch):
    from lossgauge.plans import indicator_explorer

    merged = spark.createDataFrame([("Peru, Rep.", "Peru"), ("Laos, Rep.", "Peru")], "old string, new string")
    rows = tables.indicators.withColumn("2010 [YR2010]", F.lit(None).cast("string"))
    plain = prepare_indicators(rows, merged, tables.entities)
    monkeypatch.setattr(indicator_explorer, "GROUP_LIMIT", 6)
    blocked = prepare_indicators(rows, merged, tables.entities)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, blocked.collect()))
    gap = plain.filter("year = 2010").count()
    assert gap == plain.filter("year = 2010 AND score_rank IS NOT NULL").count() == 2 * 14


def test_indicator_explorer(tables, rows):
    prepared = stable(prepare_indicators(tables.indicators, tables.renames, tables.entities))
    assert prepared.count() == len(COUNTRIES) * 14 * 6
    gap = prepared.filter((F.col("country") == "Tanzania") & (F.col("Series Name") == SCORES[0]) & (F.col("year") == 2010))
    assert gap.first()["score_rank"] is None
    explorer = IndicatorExplorer(prepared).choose(years=(2007, 2012), series="score")
    frame = prepared.toPandas()
    scores = frame[frame["year"].between(2007, 2012) & frame["Series Name"].isin(labels.SCORE_SERIES)]
    overall = scores[scores["Series Name"] == labels.OVERALL_SCORE].groupby("country")["score_rank"].mean()
    assert {r["country"]: r["score_rank"] for r in explorer.map_means().collect()} == pytest.approx(overall.to_dict())
    rest = scores[scores["Series Name"] != labels.OVERALL_SCORE]
    lines = rest.groupby(["Region", "year"])["score_rank"].mean().to_dict()
    assert {(r["Region"], r["year"]): r["score_rank"] for r in explorer.line_means("Region").collect()} == pytest.approx(lines)
    assert explorer.line_means("country", ["Peru"]).count() == 3
    assert {r["Series Name"] for r in explorer.boxes("Series Name").collect()} == set(labels.SHORT_SERIES.values()) - {"LPI Overall score"}
    ranks = IndicatorExplorer(prepared).choose(series="rank", series_name=labels.OVERALL_RANK)
    assert ranks.map_means(labels.OVERALL_RANK).count() == len(COUNTRIES)


@pytest.mark.parametrize("option", ["commodity", "country"])
def test_panels_of_one_pass_equal_the_explorer(spark, option):
    random = np.random.default_rng(5)
    n = 400
    frame = pd.DataFrame(
        {
            "country": random.choice(["Peru", "Iran", "Nan", None], n),
            "year": random.integers(2000, 2006, n),
            "commodity": random.choice(["maize", "rice", "wheat", "Nan"], n),
            "loss_percentage": random.normal(size=n).round(3) + 0.5,
            "m49_code": random.integers(1, 9, n),
            "weight": random.random(n).round(3),
        }
    ).astype(object)
    frame.loc[random.random(n) < 0.1, "loss_percentage"] = None
    frame.loc[random.random(n) < 0.1, "year"] = None
    kinds = "country string, year int, commodity string, loss_percentage double, m49_code int, weight double"
    explorer = LossExplorer(spark.createDataFrame(frame.where(frame.notna(), None), kinds))
    panels, picked = explorer.panels(option), ["Peru", "maize", "rice", "Iran"]

    def same(found, want):
        assert sorted(found.columns) == sorted(want.columns)
        columns = sorted(want.columns)
        lists = [sorted(map(tuple, df.select(*columns).collect()), key=lambda r: str([x if not isinstance(x, float) else round(x, 6) for x in r])) for df in (found, want)]
        assert len(lists[0]) == len(lists[1]) > 0
        for a, b in zip(*lists):
            assert [x if not isinstance(x, float) else pytest.approx(x, rel=1e-9, abs=1e-9) for x in a] == list(b)

    same(panels.map_means(), explorer.map_means())
    same(panels.year_means(), explorer.year_means())
    same(panels.frequencies(2), explorer.frequencies(option, 2))
    same(panels.bars(), explorer.bars(option))
    same(panels.category_year_means(picked), explorer.category_year_means(option, picked))
    same(panels.correlation(picked), explorer.correlation(option, picked))
    same(panels.category_year_counts(picked), explorer.category_year_counts(option, picked))
    same(panels.histogram(picked), explorer.histogram(option, picked))


def test_panels_read_the_rows_once(spark, monkeypatch):
    from lossgauge.plans import loss_explorer

    stored = []
    monkeypatch.setattr(loss_explorer, "stable", lambda df: stored.append(df) or stable(df))
    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("year", F.year("o_orderdate"))
    panels = LossExplorer(rows, entity="o_custkey", measure="o_totalprice").panels("o_orderpriority")
    assert stored[0]._jdf.queryExecution().executedPlan().toString().count("orders.parquet") == 1
    for df in (panels.map_means(), panels.year_means(), panels.frequencies(), panels.histogram(["1-URGENT"])):
        assert "orders.parquet" not in df._jdf.queryExecution().executedPlan().toString()


def test_the_whole_profile_of_an_explorer(spark):
    rows = [("a", "x", 2001, 1.0), ("b", None, 2002, 2.0), ("a", "x", None, 4.0), ("b", "y", 2004, 3.0)]
    df = spark.createDataFrame(rows, "country string, commodity string, year int, loss_percentage double")
    found = {name: part.collect() for name, part in LossExplorer(df).associations().items()}
    assert len(found) == 9 and all(found.values())
    assert {r["corr"] for r in found["rank correlation"] if r["a"] != r["b"]} == {1.0}
    assert len(LossExplorer(df.select("year")).associations()) == 1
