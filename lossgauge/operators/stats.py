"""Fits, mean comparison and tests, for all groups in one job.

The rows are reduced by built-in aggregates, which combine before the shuffle and so do not mind hot
groups. Python sees one aggregated row per fit or test.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossgauge.functions import linear, special
from lossgauge.operators.ordered import GROUP_LIMIT, cumulative_counts, forward_fill
from lossgauge.session import stable

NUMBERS = T.ArrayType(T.DoubleType())


# ---- least squares -------------------------------------------------------------------------------


def _symmetric(names: Sequence[str], cell) -> Column:
    """Flattened matrix from the cells of its upper triangle."""
    place = {name: i for i, name in enumerate(names)}
    return F.array(*[cell(*sorted((a, b), key=place.get)) for a in names for b in names])


def fit_least_squares(df: DataFrame, *, by: Sequence[str], target: str, features: Sequence[str]) -> DataFrame:
    """One regression with intercept per group: (by, n, coefficients), features in the given order.

    Rows with a NULL in target, features or group are left out. One aggregation gathers all second
    moments; too few rows or dependent features give the smallest-norm answer, one row gives zeros.
    """
    features = list(features)
    known = df.dropna("any", subset=[*by, target, *features])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    moments = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.covar_pop(a, b).alias(f"_{a}_{b}") for a, b in pairs],
        *[F.covar_pop(a, target).alias(f"_{a}_target") for a in features],
    )
    solve = F.pandas_udf(linear.least_squares, NUMBERS)
    gram = _symmetric(features, lambda a, b: F.col(f"_{a}_{b}"))
    return moments.select(
        *by, "n", solve(gram, F.array(*[F.col(f"_{a}_target") for a in features])).alias("coefficients")
    )


FACTORS_HELD = 10_000


def fit_nearly_dependent(
    df: DataFrame, *, by: Sequence[str], target: str, features: Sequence[str], fan: int = 64
) -> DataFrame:
    """``fit_least_squares`` for features that nearly depend on each other: (by, n, coefficients).

    Second moments square the condition number; here the rows themselves are factored. Each task reduces the rows of a
    group, batch by batch, to one triangular factor of a few rows; the factors of at most ``fan`` tasks are stacked and
    factored again, level by level, until a group has one. No task sees all rows of a hot group.
    """
    features, keys = list(features), list(by) or ["_all"]
    columns, width = [*features, target], len(features) + 2
    known = df.dropna("any", subset=[*by, *columns]).withColumn("_all", F.lit(0))
    known = known.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    kinds = [known.schema[k] for k in keys]
    result = T.StructType([*kinds, *T.StructType.fromDDL("_node long, n long, _r array<double>")])
    names, held_most = [f.name for f in result], FACTORS_HELD
    reduce_rows, merge_lists, solve_lists = linear.factor, linear.merge_factors, linear.solve_factors

    def factors(frames):
        node, held = TaskContext.get().partitionId(), {}

        def listed():
            return pd.DataFrame([(*key, node, n, r.ravel()) for key, (n, r) in held.items()], columns=names)

        for frame in frames:
            for key, part in frame.groupby(keys, sort=False):
                rows = np.column_stack([np.ones(len(part)), part.iloc[:, len(keys) :].to_numpy(dtype=float)])
                n, r = held.get(key, (0, rows[:0]))
                held[key] = n + len(part), reduce_rows(np.vstack([r, rows]))
            if len(held) > held_most:
                yield listed()
                held.clear()
        yield listed()

    merge = F.pandas_udf(lambda lists: merge_lists(lists, width), NUMBERS)
    solve = F.pandas_udf(lambda flat: solve_lists(flat, width), NUMBERS)
    level = stable(known.mapInPandas(factors, result))
    nodes = (level.agg(F.max("_node")).first()[0] or 0) + 1
    while True:
        above = F.floor(F.col("_node") / fan).alias("_node")
        # sorted, so that the result is the same in every run
        gathered = level.groupBy(*keys, above).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("_r")).alias("_r"))
        level = gathered.withColumn("_r", merge("_r"))
        nodes = -(-nodes // fan)
        if nodes == 1:
            return level.select(*by, "n", solve("_r").alias("coefficients"))


def coefficient_rows(fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """(…, feature, coef) instead of one array per fit."""
    rest = [c for c in fits.columns if c != "coefficients"]
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col("coefficients")[i].alias("coef"))
            for i, f in enumerate(features)
        ]
    )
    return fits.select(*rest, F.inline(pairs))


def coefficient_table(rows: DataFrame, group: str, labels: Sequence[str]) -> DataFrame:
    """One row per feature and one column per group."""
    return rows.groupBy("feature").pivot(group, list(labels)).agg(F.max("coef"))


# ---- group means ---------------------------------------------------------------------------------


def nearest_group(
    df: DataFrame,
    *,
    entity: str,
    group: str,
    features: Sequence[str],
    leave_out: Sequence[str] = ("Nan",),
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """(entity, n, actual_group, nearest_group, distance, is_equal) for every entity.

    The distance between an entity and a group is the absolute value of the summed differences of
    their feature means; a feature without a mean on either side is skipped. That distance compares two
    numbers, the sums of the means, so the nearest group is the neighbour below or above in sorted
    order: no entity is paired with every group.
    """
    features = list(features)
    cells = stable(
        df.filter(F.col(entity).isNotNull())
        .groupBy(F.col(entity).alias("_entity"), F.col(group).alias("_group"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.sum(F.col(f).cast("double")).alias(f"_s_{f}") for f in features],
            *[F.count(f).alias(f"_k_{f}") for f in features],
        )
    )

    def means(key: str, rows: DataFrame) -> DataFrame:
        mean = {f: F.try_divide(F.sum(f"_s_{f}"), F.sum(f"_k_{f}")) for f in features}
        present = reduce(
            lambda a, b: a + b,
            [F.when(F.sum(f"_k_{f}") > 0, F.lit(2**i)).otherwise(F.lit(0)) for i, f in enumerate(features)],
        )
        return rows.groupBy(F.col(key).alias("name")).agg(
            present.alias("mask"), *[m.alias(f"_m_{f}") for f, m in mean.items()]
        )

    entities = means("_entity", cells)
    candidates = cells.filter(F.col("_group").isNotNull() & ~F.col("_group").isin(list(leave_out)))
    groups = means("_group", candidates)

    # which means exist is a bit mask; sums are compared per pair of masks, in nearly all data just one
    def seen(rows: DataFrame) -> Column:
        return rows.agg(F.collect_set("mask").alias("masks")).scalar()

    total = reduce(
        lambda a, b: a + b,
        [
            F.when(
                (F.col("entity_mask").bitwiseAND(F.col("group_mask")).bitwiseAND(F.lit(2**i)) > 0), F.col(f"_m_{f}")
            ).otherwise(F.lit(0.0))
            for i, f in enumerate(features)
        ],
    )
    masks = ["entity_mask", "group_mask"]
    entity_points = entities.withColumnRenamed("mask", "entity_mask").withColumn("group_mask", F.explode(seen(groups)))
    group_points = groups.withColumnRenamed("mask", "group_mask").withColumn("entity_mask", F.explode(seen(entities)))
    group_points = (
        group_points.select(*masks, total.alias("value"), "name")
        .groupBy(*masks, "value")
        .agg(F.min("name").alias("neighbour"))
        .select(*masks, "value", F.lit(0).alias("side"), F.lit(None).cast(df.schema[entity].dataType).alias("name"),
                F.struct("neighbour", F.col("value").alias("at")).alias("found"))
    )
    entity_points = entity_points.select(
        *masks, total.alias("value"), F.lit(1).alias("side"), "name",
        F.lit(None).cast(group_points.schema["found"].dataType).alias("found"),
    )
    points = group_points.unionByName(entity_points)

    def candidate(found: str) -> Column:
        gap = F.abs(F.col(f"{found}.at") - F.col("value"))
        return F.when(F.col(f"{found}.neighbour").isNotNull(), F.struct(gap.alias("distance"), F.col(f"{found}.neighbour").alias("group")))

    # the stored table's row count bounds the number of points
    if cells.count() * 2 ** (len(features) + 1) <= group_limit:
        # the last group point up to an entity, on the way up and on the way down: frames that only grow, so each row
        # is gone over once per direction
        so_far = (Window.unboundedPreceding, Window.currentRow)
        upward = Window.partitionBy(*masks).orderBy("value", "side", "name").rowsBetween(*so_far)
        downward = Window.partitionBy(*masks).orderBy(F.desc("value"), "side", "name").rowsBetween(*so_far)
        last = F.last("found", ignorenulls=True)
        both = points.withColumns({"below": last.over(upward), "above": last.over(downward)})
        nearest = both.filter("side = 1").select("name", F.least(candidate("below"), candidate("above")).alias("best"))
    else:

        def neighbour(order: str) -> DataFrame:
            filled = forward_fill(
                points.withColumn("minus_value", -F.col("value")),
                ["found"],
                partition_by=masks,
                order_by=[order, "side", "name"],
                group_limit=group_limit,
            )
            return filled.filter("side = 1").select("name", candidate("found").alias("best"))

        nearest = neighbour("value").unionByName(neighbour("minus_value"))
    best = nearest.filter(F.col("best").isNotNull()).groupBy("name").agg(F.min("best").alias("best"))
    actual = cells.groupBy("_entity").agg(
        F.sum("_n").alias("n"),
        F.min_by("_group", F.when(F.col("_group").isNotNull(), F.struct(-F.col("_n"), F.col("_group")))).alias("actual_group"),
    )
    return actual.join(best, actual["_entity"] == best["name"], "left").select(
        F.col("_entity").alias(entity),
        "n",
        "actual_group",
        F.col("best.group").alias("nearest_group"),
        F.col("best.distance").alias("distance"),
        F.col("best.group").eqNullSafe(F.col("actual_group")).alias("is_equal"),
    )


# ---- tests ---------------------------------------------------------------------------------------


def sample_moments(df: DataFrame, by: str, features: Sequence[str]) -> DataFrame:
    """(by, feature, n, mean, variance) of the non-null values."""
    wide = df.filter(F.col(by).isNotNull()).groupBy(by).agg(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.count(f).alias("n"),
                F.avg(f).alias("mean"),
                # one value has no variance
                F.when(F.count(f) > 1, F.var_samp(f)).alias("variance"),
            ).alias(f"_{i}")
            for i, f in enumerate(features)
        ]
    )
    return wide.select(by, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(features))])))


# parts of a group by a hash of the entity: a bound for the rows of the windows over parts
PARTS = 1024


def _others(rows: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Adds ``_o_…``: the sum of each column over the other rows of the group, by adding what comes before and after."""
    up = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    return rows.withColumns(
        {f"_o_{c}": F.coalesce(F.sum(c).over(up), zero) + F.coalesce(F.sum(c).over(down), zero) for c in columns}
    )


def moments_without(
    df: DataFrame, pairs: DataFrame, *, entity: str, group: str, features: Sequence[str], parts: int = PARTS
) -> DataFrame:
    """(entity, group, feature, n, mean, variance) of the group's values in rows of other entities, per pair.

    Nothing is subtracted from the group's sums, which would lose the others' digits where an entity holds nearly all
    rows: the sums of all other parts of the group, and of the other entities in the own part, are added up. They are
    taken about the mean of the entities' means, which no large entity can draw away. A group without other rows gives
    n = 0.
    """
    pairs = pairs.select(entity, group).distinct()
    known = df.filter(F.col(entity).isNotNull() & F.col(group).isNotNull())
    wide = known.groupBy(group, entity).agg(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.count(f).cast("double").alias("n"),
                F.avg(f).alias("m"),
                (F.var_pop(f) * F.count(f)).alias("q"),
            ).alias(f"_{i}")
            for i, f in enumerate(features)
        ]
    )
    cells = wide.select(group, entity, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(features))]))).filter("n > 0")
    cells = stable(cells.withColumn("_part", F.pmod(F.xxhash64(entity), F.lit(parts))))
    key = [group, "feature"]
    centre = stable(cells.groupBy(*key).agg(F.avg("m").alias("_c")))
    away = F.col("m") - F.col("_c")
    sums = cells.join(centre, key).select(
        *key, entity, "_part", "n", (F.col("n") * away).alias("s"), (F.col("q") + F.col("n") * away * away).alias("t")
    )
    columns = ["n", "s", "t"]
    of_parts = sums.groupBy(*key, "_part").agg(*[F.sum(c).alias(c) for c in columns])
    outside = _others(of_parts, key, "_part", columns).select(*key, "_part", *[F.col(f"_o_{c}").alias(f"_p_{c}") for c in columns])
    inside = _others(sums, [*key, "_part"], entity, columns).select(
        *key, entity, "_part", *[F.col(f"_o_{c}").alias(f"_e_{c}") for c in columns]
    )
    # every (pair, feature) of a group with values: an entity without rows there is compared with the whole group
    whole = sums.groupBy(*key).agg(*[F.sum(c).alias(f"_w_{c}") for c in columns]).join(centre, key)
    wanted = pairs.join(whole, group).withColumn("_part", F.pmod(F.xxhash64(entity), F.lit(parts)))
    found = wanted.join(inside, [*key, entity, "_part"], "left").join(outside, [*key, "_part"], "left")
    rest = {
        c: F.when(F.col("_e_n").isNull(), F.col(f"_w_{c}")).otherwise(F.col(f"_e_{c}") + F.col(f"_p_{c}")) for c in columns
    }
    n, s, t = rest["n"], rest["s"], rest["t"]
    return found.select(
        entity,
        group,
        "feature",
        n.cast("long").alias("n"),
        (F.col("_c") + F.try_divide(s, n)).alias("mean"),
        F.when(n > 1, F.greatest(t - s * s / n, F.lit(0.0)) / (n - 1)).alias("variance"),
    )


def welch_tests(
    own: DataFrame,
    other: DataFrame,
    pairs: DataFrame,
    *,
    entity: str,
    group: str,
    level: float = 0.05,
    exclude_self: bool = False,
) -> DataFrame:
    """Unequal-variance t test of each entity against a group, per feature.

    ``own`` and ``other`` are the sample moments by entity and by group, ``pairs`` says which (entity, group) to
    compare; its further columns stay. The entity's own rows are part of the group's sample, unless ``exclude_self``
    says that ``other`` comes from ``moments_without``. Result: (pair columns, feature, statistic, dof, pval,
    significant, reason); too few or constant values give NULL and a reason.
    """
    sample = [entity, group] if exclude_self else [group]
    own = own.select(
        entity, "feature", F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("variance").alias("v1")
    )
    other = other.select(
        *sample, "feature", F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("variance").alias("v2")
    )
    joined = pairs.join(own, entity).join(other, [*sample, "feature"])
    a, b = F.try_divide(F.col("v1"), F.col("n1")), F.try_divide(F.col("v2"), F.col("n2"))
    error = a + b
    spread = F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1)
    enough = (F.col("n1") > 1) & (F.col("n2") > 1)
    measured = joined.select(
        *pairs.columns,
        "feature",
        F.when(enough, F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(error))).alias("statistic"),
        F.when(enough, F.try_divide(error * error, spread)).alias("dof"),
        F.when(~enough, "fewer than 2 values").when(error == 0, "constant values").alias("reason"),
    )
    tested = measured.withColumn("pval", special.student_two_sided(F.col("statistic"), F.col("dof")))
    return tested.select(
        *pairs.columns, "feature", "statistic", "dof", "pval", (F.col("pval") < level).alias("significant"), "reason"
    )


RUN = 10_000


def _with_scores(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per rank ``i`` with the value at that rank and its normal score ``m``.

    A value covers a run of ranks. Runs are cut where a block of ``RUN`` ranks ends, and the pieces are dealt out by
    block before they unfold: a task unfolds whole blocks of a group, however many ranks the group has.
    """
    first, last = F.floor((F.col("lo") - 1) / RUN), F.floor((F.col("hi") - 1) / RUN)
    pieces = (
        ranked.withColumn("_rank_block", F.explode(F.sequence(first, last)))
        .withColumns(
            {
                "lo": F.greatest("lo", F.col("_rank_block") * RUN + 1),
                "hi": F.least("hi", (F.col("_rank_block") + 1) * RUN),
            }
        )
        .repartition(*keys, "_rank_block")
    )
    ranks = pieces.select(*keys, "value", F.col("_size").alias("n"), F.explode(F.sequence("lo", "hi")).alias("i"))
    return special.with_normal_quantile(ranks, (F.col("i") - 0.375) / (F.col("n") + 0.25), "m")


# Royston (1995), algorithm AS R94; lowest power first.
WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
WEIGHT_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)


def normality_tests(
    df: DataFrame, *, by: str, features: Sequence[str], level: float = 0.05, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Shapiro-Wilk per group and feature: (by, feature, n, statistic, pval, normal, reason).

    Works on distinct values with counts, ranked by a running total that splits hot groups; equal values
    share a run of ranks, and runs are cut into blocks of ranks. Fewer than 3 values or a constant sample
    give NULL and a reason; above 5,000 values the p-value is given with a warning in ``reason``.
    """
    long = df.filter(F.col(by).isNotNull()).select(
        by,
        F.inline(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
        ),
    )
    keys = [by, "feature"]
    ranked = cumulative_counts(long, by=keys, value="value", group_limit=group_limit).withColumns(
        {"lo": F.col("_upto") - F.col("_n") + 1, "hi": F.col("_upto")}
    )
    scored = _with_scores(ranked, keys)
    i, n, value = F.col("i"), F.col("n"), F.col("value")

    def at(rank: Column) -> Column:
        return F.max(F.when(i == rank, value))

    # by block first, so that the rows of a group meet as one row per block
    blocks = scored.groupBy(*keys, "n", F.floor((i - 1) / RUN).alias("_rank_block")).agg(
        F.sum(F.col("m") * F.col("m")).alias("q"),
        F.sum(F.col("m") * value).alias("sx"),
        at(F.lit(1)).alias("x1"),
        at(F.lit(2)).alias("x2"),
        at(n - 1).alias("y2"),
        at(n).alias("y1"),
    )
    sums = blocks.groupBy(*keys, "n").agg(
        *[F.sum(c).alias(c) for c in ("q", "sx")], *[F.max(c).alias(c) for c in ("x1", "x2", "y2", "y1")]
    )
    # counts, and squares about the mean from the raw rows: one stable built-in aggregate
    everything = long.groupBy(*keys).agg(
        F.count("value").alias("n"), (F.var_pop("value") * F.count("value")).alias("ss")
    )
    row = everything.filter(F.col("n") >= 3).join(sums.drop("n"), keys)

    n = F.col("n").cast("double")
    row = special.with_normal_quantile(row, (n - 0.375) / (n + 0.25), "m1")
    row = special.with_normal_quantile(row, (n - 1.375) / (n + 0.25), "m2")
    last = special.polynomial(WEIGHT_LAST, "1 / sqrt(n)") + F.col("m1") / F.sqrt("q")
    second = special.polynomial(WEIGHT_SECOND, "1 / sqrt(n)") + F.col("m2") / F.sqrt("q")
    row = row.withColumn("a1", F.when(F.col("n") == 3, F.sqrt(F.lit(0.5))).otherwise(last)).withColumn(
        "a2", F.when(F.col("n") > 5, second)
    )
    outer = F.col("m1") * (F.col("y1") - F.col("x1"))
    next_ = F.col("m2") * (F.col("y2") - F.col("x2"))
    a1, a2, q = F.col("a1"), F.col("a2"), F.col("q")
    phi_one = (q - 2 * F.col("m1") ** 2) / (1 - 2 * a1 * a1)
    phi_two = (q - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    ends = a1 * (F.col("y1") - F.col("x1"))
    numerator = (
        F.when(F.col("n") == 3, ends)
        .when(F.col("n") <= 5, ends + (F.col("sx") - outer) / F.sqrt(phi_one))
        .otherwise(ends + a2 * (F.col("y2") - F.col("x2")) + (F.col("sx") - outer - next_) / F.sqrt(phi_two))
    )
    varies = F.col("y1") > F.col("x1")
    row = row.withColumn("statistic", F.when(varies, F.least(F.try_divide(numerator * numerator, F.col("ss")), F.lit(1.0))))
    w = F.col("statistic")
    miss = F.log(F.greatest(1 - w, F.lit(1e-300)))
    gamma = special.polynomial(SMALL_GAMMA, "n")
    small_z = (-F.log(gamma - miss) - special.polynomial(SMALL_MEAN, "n")) / F.exp(special.polynomial(SMALL_SPREAD, "n"))
    large_z = (miss - special.polynomial(LARGE_MEAN, "ln(n)")) / F.exp(special.polynomial(LARGE_SPREAD, "ln(n)"))
    row = row.withColumn(
        "z", F.when((F.col("n") > 3) & (F.col("n") <= 11), F.when(miss < gamma, small_z)).when(F.col("n") > 11, large_z)
    ).withColumn("upper", special.normal_upper_tail(F.col("z")))
    three = F.greatest(6 / F.lit(float(3.141592653589793)) * (F.asin(F.sqrt(w)) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0))
    pval = (
        F.when(w.isNull(), None)
        .when(F.col("n") == 3, three)
        .when((F.col("n") <= 11) & (miss >= gamma), F.lit(0.0))
        .otherwise(F.col("upper"))
    )
    tested = row.withColumn("pval", pval)
    return everything.join(tested.select(*keys, "statistic", "pval"), keys, "left").select(
        *keys,
        "n",
        "statistic",
        "pval",
        (F.col("pval") >= level).alias("normal"),
        F.when(F.col("n") < 3, "fewer than 3 values")
        .when(F.col("statistic").isNull(), "constant values")
        .when(F.col("n") > 5000, "p-value may be inaccurate above 5000 values")
        .alias("reason"),
    )


# ---- correlation ---------------------------------------------------------------------------------


def pair_correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are known; NULL for a constant, not an error."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread_a = F.var_pop(F.when(both, F.col(a)))
    spread_b = F.var_pop(F.when(both, F.col(b)))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(spread_a * spread_b))


def correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long correlation matrix (by, a, b, corr) of the given columns, one pass over the rows."""
    columns = list(columns)
    pairs = list(combinations(columns, 2))
    wide = df.groupBy(*by).agg(
        *[pair_correlation(a, b).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)],
        *[F.when(F.var_pop(c) > 0, F.lit(1.0)).alias(f"_d{i}") for i, c in enumerate(columns)],
    )
    cells = [(a, b, f"_p{i}") for i, (a, b) in enumerate(pairs)]
    cells += [(b, a, name) for a, b, name in cells]
    cells += [(c, c, f"_d{i}") for i, c in enumerate(columns)]
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(name).alias("corr")) for a, b, name in cells]
    )
    return wide.select(*by, F.inline(rows))


def one_hot_correlation(
    df: DataFrame, *, category: str, measure: str, selected: Sequence[str], others: Sequence[str] = ()
) -> DataFrame:
    """Correlation of ``measure`` with itself, other numeric columns and one 0/1 column per category.

    ``df`` holds the means per category and year. Only rows of the selected categories count; nothing
    selected gives no rows. Result (column, corr). The 0/1 columns are never built: per category a
    count and a sum suffice.
    """
    rows = df.filter(F.col(category).isin(list(selected)))
    known = rows.filter(F.col(measure).isNotNull())
    whole = known.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.avg(measure).alias("mean"), F.var_pop(measure).alias("variance")
        ).alias("w")
    ).scalar()
    per = rows.groupBy(category).agg(F.count(measure).alias("_k"), F.avg(measure).alias("_m")).withColumn("_w", whole)
    part = F.try_divide(F.col("_k").cast("double"), F.col("_w.n"))
    # covariance of a 0/1 column: share * (mean inside - mean overall)
    cover = F.coalesce(part * (F.col("_m") - F.col("_w.mean")), F.lit(0.0))
    flags = per.select(
        F.concat(F.lit(f"{category}_"), F.col(category)).alias("column"),
        F.try_divide(cover, F.sqrt(part * (1 - part) * F.col("_w.variance"))).alias("corr"),
    )
    columns = [measure, *others]
    wide = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.when(F.var_pop(measure) > 0, F.lit(1.0)).alias("_c0"),
        *[pair_correlation(measure, c).alias(f"_c{i}") for i, c in enumerate(others, 1)],
    ).filter("_rows > 0")
    numbers = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("corr"))
                    for i, c in enumerate(columns)
                ]
            )
        )
    )
    return numbers.unionByName(flags)


# ---- factor checks -------------------------------------------------------------------------------


def _correlation_arrays(df: DataFrame, by: Sequence[str], items: Sequence[str]) -> DataFrame:
    pairs = list(combinations(items, 2))
    known = df.dropna("any", subset=[*by, *items])
    wide = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[pair_correlation(a, b).alias(f"_{a}_{b}") for a, b in pairs],
    )
    matrix = _symmetric(items, lambda a, b: F.lit(1.0) if a == b else F.col(f"_{a}_{b}"))
    return wide.select(*by, "n", matrix.alias("matrix"))


def bartlett_sphericity(df: DataFrame, *, by: Sequence[str], items: Sequence[str]) -> DataFrame:
    """(by, n, statistic, dof, pval): is the correlation matrix the identity? NULL if singular."""
    p = len(items)
    log_det = F.pandas_udf(linear.log_determinant, T.DoubleType())
    rows = _correlation_arrays(df, by, items).select(
        *by, "n", F.nanvl(log_det("matrix"), F.lit(None).cast("double")).alias("log_det")
    )
    factor = F.col("n") - 1 - (2 * p + 5) / 6
    tested = rows.select(
        *by, "n", (-F.col("log_det") * factor).alias("statistic"), F.lit(p * (p - 1) // 2).alias("dof")
    )
    return tested.withColumn("pval", special.chi_square_upper(F.col("statistic"), F.col("dof").cast("double")))


def sampling_adequacy(df: DataFrame, *, by: Sequence[str], items: Sequence[str]) -> DataFrame:
    """Kaiser-Meyer-Olkin measure: (by, item, kmo), with item 'overall' for the whole set."""
    p = len(items)
    partial = F.pandas_udf(linear.partial_correlations, NUMBERS)
    rows = _correlation_arrays(df, by, items).withColumn("partial", partial("matrix"))

    def squares(column: str, lines) -> Column:
        cells = [F.col(column)[i * p + j] ** 2 for i in lines for j in range(p) if i != j]
        return reduce(lambda a, b: a + b, cells)

    def measure(lines) -> Column:
        plain, part = squares("matrix", lines), squares("partial", lines)
        return F.nanvl(F.try_divide(plain, plain + part), F.lit(None).cast("double"))

    labelled = [(item, [i]) for i, item in enumerate(items)] + [("overall", list(range(p)))]
    return rows.select(
        *by,
        F.inline(F.array(*[F.struct(F.lit(k).alias("item"), measure(v).alias("kmo")) for k, v in labelled])),
    )
