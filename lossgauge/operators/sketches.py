"""A table profile kept as state: one small row per part and column, merged without the rows.

A state holds exact counts, extremes and moments, and three mergeable sketches: HyperLogLog for distinct values, KLL for
quantiles, and a counter table for frequent values. States of parts are stored as a table; the profile of any union of
parts comes from their states alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lossgauge.operators.profile import short_value

# sizes of the sketches, and what they promise
DISTINCT_BITS = 12  # registers, as a power of two
QUANTILE_K = 400
FREQUENT_ITEMS = 1024
# one standard error of the distinct count: 1.04 / sqrt(registers); three of them hold for 99.7 %
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_BITS / 2)
# error of a rank as a share of the rows, at 99 %: 2.296 / k^0.9021
QUANTILE_ERROR = 2.296 / QUANTILE_K**0.9021
# error of a frequency as a share of the rows
FREQUENT_ERROR = 3.5 / FREQUENT_ITEMS


QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def profile_states(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, rows, n, lowest, highest, mean, squares, distinct, quantiles, frequent): a state per part and column.

    All states come from one aggregation, combined on the map side. ``rows`` counts rows, ``n`` known values; numbers
    have extremes, mean, sum of squares about it and a quantile sketch, empty or NULL for other columns. Values enter
    the distinct and frequent sketches as text, long ones by length and digest.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    number = {c: isinstance(kinds[c], NumericType) for c in columns}
    prepared = df.select(
        *by,
        *[(F.col(c).cast("double") if number[c] else F.lit(None).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)],
        *[short_value(c).alias(f"_t{i}") for i, c in enumerate(columns)],
    )
    states = [_state(c, f"_v{i}", f"_t{i}").alias(f"_{i}") for i, c in enumerate(columns)]
    wide = prepared.groupBy(*by).agg(*states)
    return wide.select(*by, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))


def _state(name: str, value: str, text: str) -> Column:
    return F.struct(
        F.lit(name).alias("column"),
        F.count(F.lit(1)).alias("rows"),
        F.count(text).alias("n"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("squares"),
        F.hll_sketch_agg(text, F.lit(DISTINCT_BITS)).alias("distinct"),
        F.kll_sketch_agg_double(value, F.lit(QUANTILE_K)).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate({text}, {FREQUENT_ITEMS})").alias("frequent"),
    )


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The states of unions of parts: all parts that agree in ``by`` become one. The result merges further."""
    keys = [*by, "column"]
    means = states.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("_mean")
    )
    renamed = means.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [states[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    # squares about the common mean, from those about each part's own: nothing is subtracted
    moved = F.col("squares") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    return (
        states.join(renamed, same)
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            F.min("lowest").alias("lowest"),
            F.max("highest").alias("highest"),
            F.max("_mean").alias("mean"),
            F.sum(moved).alias("squares"),
            F.hll_union_agg("distinct").alias("distinct"),
            F.kll_merge_agg_double("quantiles").alias("quantiles"),
            F.expr(f"approx_top_k_combine(frequent, {FREQUENT_ITEMS})").alias("frequent"),
        )
    )


def profile_of_states(states: DataFrame, top: int = 10) -> DataFrame:
    """(…, column, rows, n, missing, lowest, highest, mean, deviation, distinct_values, p5 … p95, frequent), one row per state.

    Counts, extremes and moments are exact. ``distinct_values`` is off by ``DISTINCT_ERROR`` of itself at most (three
    standard errors), a quantile's rank by ``QUANTILE_ERROR`` of the rows (99 %), a count in ``frequent`` by
    ``FREQUENT_ERROR`` of the rows. ``frequent`` lists (value, n), most frequent first.
    """
    sketches = ["squares", "distinct", "quantiles", "frequent"]
    kept = [c for c in states.columns if c not in sketches and c not in ("rows", "n", "lowest", "highest", "mean")]
    numbers = F.col("mean").isNotNull()
    quantile = {
        name: F.when(numbers, F.kll_sketch_get_quantile_double(F.when(numbers, F.col("quantiles")), F.lit(p)))
        for name, p in QUANTILES.items()
    }
    listed = F.expr(f"approx_top_k_estimate(frequent, {top})")
    return states.select(
        *kept,
        "rows",
        "n",
        (F.col("rows") - F.col("n")).alias("missing"),
        "lowest",
        "highest",
        "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("deviation"),
        F.hll_sketch_estimate("distinct").alias("distinct_values"),
        *[q.alias(name) for name, q in quantile.items()],
        F.transform(
            F.filter(listed, lambda x: x["item"].isNotNull()),
            lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n")),
        ).alias("frequent"),
    )


def measured_errors(df: DataFrame, profile: DataFrame) -> DataFrame:
    """(column, distinct_error, quantile_error, frequent_error): how far a profile of ``profile_of_states`` is off its rows.

    Each error is a share as in the promises; quantiles and frequent values give their largest. Three exact passes: this
    is for measuring the sketches, not for making a profile. One row per column reaches the driver.
    """
    found = {r["column"]: r for r in profile.collect()}
    passes = []
    for c, r in found.items():
        n = F.lit(float(max(r["n"], 1)))
        wrong = [F.lit(0.0)]
        for name, p in QUANTILES.items():
            if r[name] is not None:
                below = F.count_if(F.col(c).cast("double") < r[name]) / n
                up_to = F.count_if(F.col(c).cast("double") <= r[name]) / n
                wrong += [below - p, p - up_to]
        distinct = F.count_distinct(short_value(c))
        counts = [
            F.abs(F.count_if(short_value(c) == x["value"]) - x["n"]) / n for x in r["frequent"]
        ]
        passes.append(
            df.agg(
                F.lit(c).alias("column"),
                (F.abs(distinct - F.lit(r["distinct_values"])) / F.greatest(distinct, F.lit(1))).alias("distinct_error"),
                F.greatest(*wrong, F.lit(0.0)).alias("quantile_error"),
                F.greatest(*counts, F.lit(0.0), F.lit(0.0)).alias("frequent_error"),
            )
        )
    result = passes[0]
    for more in passes[1:]:
        result = result.unionByName(more)
    return result
