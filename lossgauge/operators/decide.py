"""Which regression to trust, the priorities it gives and the catalogue in that order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossgauge.functions.scalar import ordinal_label
from lossgauge.operators.ordered import GROUP_LIMIT, running_total

OWN, ACTUAL, NEAREST = "own", "actual group", "nearest group"


def significant_counts(tests: DataFrame, entity: str) -> DataFrame:
    """(entity, actual_significant, nearest_significant): significant features against either group.

    ``tests`` tells the two comparisons apart by ``role``. A test without a p-value does not count.
    """
    significant = F.coalesce(F.col("significant"), F.lit(False))
    return tests.groupBy(entity).agg(
        F.count_if((F.col("role") == ACTUAL) & significant).alias("actual_significant"),
        F.count_if((F.col("role") == NEAREST) & significant).alias("nearest_significant"),
    )


def select_model(
    fits: DataFrame, comparison: DataFrame, counts: DataFrame, *, entity: str, few: int = 5
) -> DataFrame:
    """(entity, n, actual_group, nearest_group, chosen, model_group) of every entity in ``comparison``.

    ``fits`` has (entity, coefficients), ``comparison`` (entity, n, actual_group, nearest_group, is_equal) with all rows
    counted, and ``counts`` (entity, actual_significant, nearest_significant). An entity keeps its own fit unless
    it has at most ``few`` rows, no fit (no complete row), or coefficients that sum to zero. Then it takes its
    group's fit if that group is also the nearest; otherwise the nearest group's, provided the entity differs
    from its own group in at least as many features as from the nearest.
    """
    total = F.aggregate("coefficients", F.lit(0.0), lambda a, b: a + b)
    joined = comparison.join(fits.select(entity, total.alias("_sum")), entity, "left").join(counts, entity, "left")
    weak = (F.col("n") <= few) | (F.coalesce("_sum", F.lit(0.0)) == 0)
    differs = F.coalesce("actual_significant", F.lit(0)) >= F.coalesce("nearest_significant", F.lit(0))
    chosen = F.when(weak & F.col("is_equal"), ACTUAL).when(weak & differs, NEAREST).otherwise(OWN)
    return joined.select(entity, "n", "actual_group", "nearest_group", chosen.alias("chosen")).withColumn(
        "model_group",
        F.when(F.col("chosen") == ACTUAL, F.col("actual_group")).when(
            F.col("chosen") == NEAREST, F.col("nearest_group")
        ),
    )


def chosen_coefficients(
    selection: DataFrame, own: DataFrame, by_group: DataFrame, *, entity: str, group: str, features: Sequence[str]
) -> DataFrame:
    """(entity, feature, coef) from the regression each entity was given.

    One pass over ``selection``: both fits, (entity, coefficients) and (group, coefficients), are joined to it as one
    row each, and only the chosen one is unfolded. An entity whose chosen fit doesn't exist has no rows.
    """
    mine = own.select(entity, F.col("coefficients").alias("_own"))
    theirs = by_group.filter(F.col(group).isNotNull()).select(
        F.col(group).alias("model_group"), F.col("coefficients").alias("_lent")
    )
    both = selection.join(mine, entity, "left").join(theirs, "model_group", "left")
    picked = both.select(entity, F.when(F.col("chosen") == OWN, F.col("_own")).otherwise(F.col("_lent")).alias("_fit"))
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col("_fit")[i].alias("coef")) for i, f in enumerate(features)]
    )
    return picked.filter(F.col("_fit").isNotNull()).select(entity, F.inline(pairs))


def rank_priorities(rows: DataFrame, *, entity: str) -> DataFrame:
    """Features with a negative coefficient, the most negative first.

    Result (entity, feature, coef, weight, priority): the highest weight goes with priority 1. Groups are as
    small as the feature list.
    """
    negative = rows.filter(F.col("coef") < 0)
    rising = Window.partitionBy(entity).orderBy(F.desc("coef"), F.asc("feature"))
    falling = Window.partitionBy(entity).orderBy(F.asc("coef"), F.desc("feature"))
    return negative.withColumn("weight", F.row_number().over(rising)).withColumn(
        "priority", F.row_number().over(falling)
    )


def rank_catalogue(
    catalogue: DataFrame, *, category: str, item: str, loading: str, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Position of each item within its category by falling loading, unknown loadings last, ties by item."""
    ordered = catalogue.withColumns({"_unknown": F.col(loading).isNull(), "_down": -F.col(loading)})
    ranked = running_total(
        ordered, partition_by=[category], order_by=["_unknown", "_down", item], name="position", group_limit=group_limit
    )
    return ranked.drop("_unknown", "_down")


def list_catalogue(
    priorities: DataFrame,
    ranked: DataFrame,
    *,
    entity: str,
    category: str,
    feature: str = "feature",
    entities: Sequence[object] | None = None,
) -> DataFrame:
    """Catalogue items of every prioritised category: priority label, then position in the category.

    Every entity is listed with every item of its categories. ``entities`` narrows the list to those that are
    shown; for all of many entities keep ``compact_list`` and the ranked catalogue apart.
    """
    if entities is not None:
        priorities = priorities.filter(F.col(entity).isin(list(entities)))
    wanted = priorities.select(entity, F.col(feature).alias(category), "priority")
    return wanted.join(ranked, category).withColumn("label", ordinal_label(F.col("priority")))


def compact_list(priorities: DataFrame, ranked: DataFrame, *, entity: str, category: str, feature: str = "feature") -> DataFrame:
    """(entity, category, priority, label, items): one row per prioritised category that has items, and how many.

    With ``ranked``, which holds the items of a category once, it says all that the full list does.
    """
    sizes = ranked.groupBy(category).agg(F.count(F.lit(1)).alias("items"))
    wanted = priorities.select(entity, F.col(feature).alias(category), "priority")
    return wanted.join(sizes, category).withColumn("label", ordinal_label(F.col("priority")))


def with_details(listed: DataFrame, details: Sequence[str]) -> DataFrame:
    """The second list: only items whose detail texts are all known."""
    condition = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in details])
    return listed.filter(condition)
