"""Group summaries and the data behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lossgauge.functions.scalar import percent_label
from lossgauge.operators.ordered import GROUP_LIMIT, exact_quantiles, value_counts_by


def numeric_columns(df: DataFrame, leave_out: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in leave_out]


def with_known_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A NULL key forms no group."""
    return df.dropna("any", subset=list(by))


def mean_by(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Means per group, of all numeric columns unless a list is given."""
    columns = list(columns) if columns else numeric_columns(df, by)
    return with_known_keys(df, by).groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def count_by(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null counts per group and column."""
    columns = list(columns) if columns else [c for c in df.columns if c not in by]
    return with_known_keys(df, by).groupBy(*by).agg(*[F.count(c).alias(c) for c in columns])


def frequency(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    """How often each value occurs, NULL left out."""
    return with_known_keys(df, [column]).groupBy(column).agg(F.count(F.lit(1)).alias(count))


def top_with_others(df: DataFrame, column: str, top: int = 7, others: str = "Others") -> DataFrame:
    """(value, n, share, percent) of the ``top`` most frequent values and one row for the rest.

    Ties go by value. The row for the rest is left out if it would be zero. Only the ``top`` rows and
    two totals meet in one task.
    """
    return top_of_counts(frequency(df, column), column, top, others)


def top_of_counts(counts: DataFrame, column: str, top: int = 7, others: str = "Others") -> DataFrame:
    """``top_with_others`` from (value, n)."""
    counts = counts.withColumn(column, F.col(column).cast("string"))
    leading = counts.orderBy(F.desc("n"), F.asc(column)).limit(top)
    everything = counts.agg(F.sum("n").alias("n"))
    head = leading.agg(F.sum("n").alias("n"))
    rest = everything.select(
        F.lit(others).alias(column), (F.col("n") - head.scalar()).alias("n")
    ).filter(F.col("n") > 0)
    shown = leading.select(column, "n").unionByName(rest)
    share = F.try_divide(F.col("n").cast("double"), everything.scalar())
    return shown.withColumn("share", share).withColumn("percent", percent_label(F.col("share")))


def mode_by(df: DataFrame, by: Sequence[str], column: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group, the smallest on a tie. Two aggregations, no value lists."""
    counts = value_counts_by(with_known_keys(df, by), by, column)
    return counts.groupBy(*by).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(name))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) for the menus: all distinct values of several columns in one pass."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return df.select(pairs.alias("_pair")).select("_pair.column", "_pair.value").distinct()


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, lowest, highest), one row per column."""
    ends = df.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"lo_{c}").cast("double").alias("lowest"),
                F.col(f"hi_{c}").cast("double").alias("highest"),
            )
            for c in columns
        ]
    )
    return ends.select(F.inline(rows))


def row_max_ignoring_zero(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Greatest value across columns, zero counting as missing."""
    values = [F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return df.withColumn(name, values[0] if len(values) == 1 else F.greatest(*values))


def scale_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column moved to 0..1; a constant column becomes 0."""
    ends = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    bounds = ends.select(F.struct(*ends.columns).alias("b")).scalar()
    scaled = df.withColumn("_b", bounds)
    for c in columns:
        low, high = F.col("_b")[f"lo_{c}"], F.col("_b")[f"hi_{c}"]
        width = F.when(high == low, F.lit(1.0)).otherwise((high - low).cast("double"))
        scaled = scaled.withColumn(c, (F.col(c) - low) / width)
    return scaled.drop("_b")


def histogram_sum(
    df: DataFrame, *, x: str, y: str, colour: str, bins: int | None = None
) -> DataFrame:
    """Sum of ``y`` per bin of ``x`` and colour: (colour, bin, bin_start, bin_end, total).

    The bins have equal width from the lowest to the highest ``x``. Without ``bins`` there is one bin
    per whole number, as for years.
    """
    ends = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    if bins is None:
        ends = ends.select("lo", F.lit(1.0).alias("width"), F.lit(None).cast("int").alias("last"))
    else:
        width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
        ends = ends.select("lo", width.alias("width"), F.lit(bins - 1).alias("last"))
    grid = df.filter(F.col(x).isNotNull()).withColumn("_g", ends.select(F.struct("*").alias("g")).scalar())
    lo, width = F.col("_g.lo"), F.col("_g.width")
    index = F.floor((F.col(x) - lo) / width).cast("int")
    # the highest value belongs to the last bin; least() passes over a NULL bound
    binned = grid.withColumn("bin", F.least(index, F.col("_g.last"))).groupBy(colour, "bin").agg(
        F.sum(y).alias("total"), F.first("_g").alias("_g")
    )
    return binned.select(
        colour,
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "total",
    )


def box_plot(
    df: DataFrame, by: str, value: str, *, method: str = "hazen", group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Quartiles, whiskers at the furthest points within 1.5 quartile ranges, and outlier count."""
    known = with_known_keys(df, [by])
    quartiles = exact_quantiles(
        known,
        by=[by],
        value=value,
        probabilities={"q1": 0.25, "median": 0.5, "q3": 0.75},
        method=method,
        group_limit=group_limit,
    )
    counts = value_counts_by(known, [by], value)
    fences = quartiles.withColumn("_reach", 1.5 * (F.col("q3") - F.col("q1")))
    inside = F.col(value).between(F.col("q1") - F.col("_reach"), F.col("q3") + F.col("_reach"))
    return (
        counts.join(fences, by)
        .groupBy(by, "n", "q1", "median", "q3")
        .agg(
            F.least(F.min(F.when(inside, F.col(value))), F.col("q1")).alias("lower_whisker"),
            F.greatest(F.max(F.when(inside, F.col(value))), F.col("q3")).alias("upper_whisker"),
            F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"),
        )
    )


def box_plot_outliers(df: DataFrame, by: str, value: str, boxes: DataFrame) -> DataFrame:
    """The rows drawn as single points: those beyond the whiskers of their box."""
    edges = boxes.select(by, "lower_whisker", "upper_whisker")
    beyond = (F.col(value) < F.col("lower_whisker")) | (F.col(value) > F.col("upper_whisker"))
    return df.join(edges, by).filter(beyond).drop("lower_whisker", "upper_whisker")
