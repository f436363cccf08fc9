"""From loss and indicator tables to a ranked policy list, for every entity at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgauge.functions.scalar import clean_text, map_values, to_number
from lossgauge.operators import clean, decide, stats
from lossgauge.operators.enrich import attach_dimension, join_facts, lookup_rename
from lossgauge.operators.panel import densify_and_reattach
from lossgauge.operators.reshape import stack_years
from lossgauge.operators.summarize import mean_by
from lossgauge.plans import labels
from lossgauge.session import stable


@dataclass(frozen=True)
class Inputs:
    losses: DataFrame
    indicators: DataFrame
    renames: DataFrame
    entities: DataFrame
    commodities: DataFrame


@dataclass(frozen=True)
class Columns:
    """Roles of the columns of a panel."""

    entity: str = "country"
    year: str = "year"
    group: str = "Income"
    target: str = "loss_percentage"
    features: Sequence[str] = tuple(labels.SCORE_CATEGORIES.values())


@dataclass(frozen=True)
class Ranking:
    comparison: DataFrame
    own_fits: DataFrame
    group_fits: DataFrame
    tests: DataFrame
    selection: DataFrame
    coefficients: DataFrame
    priorities: DataFrame
    normality: DataFrame | None


def clean_losses(
    losses: DataFrame,
    *,
    stages: Sequence[str] = labels.LOSS_STAGES,
    names: Mapping[str, str] = labels.COUNTRY_NAMES,
    denied: Sequence[str] = labels.DENIED_AREAS,
) -> DataFrame:
    kept = clean.keep_values(losses, "food_supply_stage", stages)
    renamed = clean.replace_values(clean.drop_duplicate_rows(kept), "country", names)
    return clean.drop_values(renamed, "country", denied)


def indicator_years(indicators: DataFrame, renames: DataFrame) -> DataFrame:
    """(country, year, one column per score category)."""
    old, new = renames.columns
    named = lookup_rename(indicators, "Country Name", renames, old, new).select(
        F.col("Country Name").alias("country"),
        F.col("Series Name").alias("series"),
        *[F.col(f"`{c}`") for c in labels.YEAR_COLUMNS],
    )
    scores = clean.drop_incomplete(clean.keep_matching(named, "series", "score"))
    stacked = stack_years(
        scores, entity="country", series="series", years=labels.YEAR_COLUMNS, labels=list(labels.SCORE_CATEGORIES)
    )
    return stacked.select(
        "country",
        "year",
        *[to_number(F.col(f"`{series}`")).alias(short) for series, short in labels.SCORE_CATEGORIES.items()],
    )


def build_panel(inputs: Inputs) -> DataFrame:
    """Yearly panel of scores, loss and groups; the loss is the measured one.

    Filling within an entity before the yearly step would change nothing: the yearly step takes the last
    known value of a year and the later fill carries it on. So there is no window over the raw rows.
    """
    means = mean_by(
        clean_losses(inputs.losses), ["country", "year", "commodity", "food_supply_stage"], ["loss_percentage"]
    )
    scores = indicator_years(inputs.indicators, inputs.renames).withColumnsRenamed(
        {"country": "_country", "year": "_year"}
    )
    joined = join_facts(scores, means, ["_country", "_year"], ["country", "year"]).drop("_country", "_year")
    enriched = attach_dimension(joined, inputs.entities, "country", "Country")
    enriched = attach_dimension(enriched, inputs.commodities, "commodity", "Commodities")
    features = list(labels.SCORE_CATEGORIES.values())
    panel = densify_and_reattach(
        enriched,
        means,
        entity="country",
        year="year",
        order_by=["commodity", "food_supply_stage"],
        columns=[*features, "commodity", "food_supply_stage", "Region", "Income", "Commodity Groups"],
        keys=["country", "year", "commodity", "food_supply_stage"],
        measure="loss_percentage",
    ).drop("commodity")
    income = map_values(clean_text(F.col("Income")), labels.INCOME_LABELS)
    return panel.withColumn("Income", income)


def normality(panel: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """(kind, name, feature, n, statistic, pval, normal, reason) of every entity and every group.

    An entity's actual and nearest group stand in the comparison, so the tests of all three are found by name.
    """
    tests = [
        stats.normality_tests(panel, by=by, features=list(columns.features)).select(
            F.lit(kind).alias("kind"), F.col(by).cast("string").alias("name"), "feature", "n", "statistic", "pval", "normal", "reason"
        )
        for by, kind in ((columns.entity, "entity"), (columns.group, "group"))
    ]
    return tests[0].unionByName(tests[1])


def rank_categories(
    panel: DataFrame,
    columns: Columns = Columns(),
    few: int = 5,
    with_normality: bool = False,
    exclude_self: bool = False,
) -> Ranking:
    """Fits, comparison, tests, selection and priorities of all entities, and normality tests if asked for.

    ``exclude_self`` leaves an entity's own rows out of the groups it is tested against.

    The panel feeds several aggregations: pass a stored or cached one.
    """
    entity, group, features = columns.entity, columns.group, list(columns.features)
    own = stats.fit_least_squares(panel, by=[entity], target=columns.target, features=features)
    grouped = stats.fit_least_squares(panel, by=[group], target=columns.target, features=features)
    comparison = stable(stats.nearest_group(panel, entity=entity, group=group, features=features))
    roles = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.col(name).alias(group))
            for role, name in ((decide.ACTUAL, "actual_group"), (decide.NEAREST, "nearest_group"))
        ]
    )
    pairs = comparison.select(entity, F.inline(roles))
    if exclude_self:
        samples = stats.moments_without(panel, pairs, entity=entity, group=group, features=features)
    else:
        samples = stats.sample_moments(panel, group, features)
    own_samples = stats.sample_moments(panel, entity, features)
    tests = stats.welch_tests(
        own_samples, samples, pairs, entity=entity, group=group, exclude_self=exclude_self
    )
    counts = decide.significant_counts(tests, entity)
    selection = decide.select_model(own, comparison, counts, entity=entity, few=few)
    coefficients = decide.chosen_coefficients(
        selection, own, grouped, entity=entity, group=group, features=features
    )
    priorities = decide.rank_priorities(coefficients, entity=entity)
    tested = normality(panel, columns) if with_normality else None
    return Ranking(comparison, own, grouped, tests, selection, coefficients, priorities, tested)


def list_policies(
    priorities: DataFrame,
    catalogue: DataFrame,
    *,
    entity: str = "country",
    category: str = "LPI-category",
    item: str = "Policy",
    loading: str = "factor_loadings",
    entities: Sequence[object] | None = None,
    details: Sequence[str] = (),
) -> DataFrame:
    """Policies of each prioritised category, by falling factor loading; of ``entities`` only, if given.

    ``details`` names texts that must be known: the second list.
    """
    ranked = decide.rank_catalogue(catalogue, category=category, item=item, loading=loading)
    listed = decide.list_catalogue(priorities, ranked, entity=entity, category=category, entities=entities)
    return decide.with_details(listed, details) if details else listed
