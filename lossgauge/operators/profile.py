"""Table profile: counts, moments, quantiles, frequent values, histogram, duplicates, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lossgauge.operators.ordered import GROUP_LIMIT, exact_quantiles
from lossgauge.operators.stats import correlations
from lossgauge.operators.summarize import frequency, numeric_columns

QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _pairs(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(column, value) rows; they collapse to counts before any shuffle."""
    items = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns]
    )
    return df.select(F.inline(items))


LONG_TEXT = 64


def short_value(name: str) -> Column:
    """A stand-in for counting a value: long text by its length and SHA-256 digest, so that the text is not shuffled.

    A mark sets digests apart from short values that look like one.
    """
    text = F.col(name).cast("string")
    digest = F.concat_ws(":", F.lit("digest"), F.length(text).cast("string"), F.sha2(text, 256))
    return F.when(F.length(text) > LONG_TEXT, digest).otherwise(text)


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, type, n, missing, distinct_values, unique_values) for columns of any type.

    Counts are exact; texts of over ``LONG_TEXT`` characters are told apart by length and SHA-256 digest.
    """
    columns = list(columns) if columns else df.columns
    types = dict(df.dtypes)
    items = F.array(*[F.struct(F.lit(c).alias("column"), short_value(c).alias("value")) for c in columns])
    counts = df.select(F.inline(items)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    known = F.col("value").isNotNull()
    summary = counts.groupBy("column").agg(
        F.sum("k").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("k"))), F.lit(0)).alias("missing"),
        F.count_if(known).alias("distinct_values"),
        F.count_if(known & (F.col("k") == 1)).alias("unique_values"),
    )
    kind = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return summary.select("column", kind[F.col("column")].alias("type"), "n", "missing", "distinct_values", "unique_values")


def profile_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """One row per numeric column: moments, extremes, exact quantiles, zeros and negatives."""
    columns = list(columns) if columns else numeric_columns(df)
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("n"),
                F.count_if(F.col(c).isNull()).alias("missing"),
                F.count_if(F.col(c) == 0).alias("zeros"),
                F.count_if(F.col(c) < 0).alias("negatives"),
                F.min(c).cast("double").alias("lowest"),
                F.max(c).cast("double").alias("highest"),
                F.sum(F.col(c).cast("double")).alias("total"),
                F.avg(c).alias("mean"),
                F.when(F.count(c) > 1, F.stddev_samp(c)).alias("deviation"),
                F.when(F.var_pop(c) > 0, F.skewness(c)).alias("_g1"),
                F.when(F.var_pop(c) > 0, F.kurtosis(c)).alias("_g2"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    ).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))
    n = F.col("n").cast("double")
    skewness = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurtosis = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))
    moments = wide.withColumns(
        {
            "spread": F.col("highest") - F.col("lowest"),
            "variation": F.try_divide(F.col("deviation"), F.col("mean")),
            "skewness": skewness,
            "kurtosis": kurtosis,
        }
    ).drop("_g1", "_g2")
    quantiles = exact_quantiles(
        _pairs(df, columns, "double"),
        by=["column"],
        value="value",
        probabilities=QUANTILES,
        group_limit=group_limit,
    ).drop("n")
    return moments.join(quantiles, "column", "left").withColumn("quartile_range", F.col("p75") - F.col("p25"))


def profile_frequent(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """(column, value, n, position): the ``top`` most frequent values of each column, ties by value.

    One top-``top`` sort per column over a scan of that column, so that a column with very many values is
    not ranked in one task.
    """
    leading = None
    for c in columns:
        best = (
            frequency(df, c)
            .select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "n")
            .orderBy(F.desc("n"), F.asc("value"))
            .limit(top)
        )
        leading = best if leading is None else leading.unionByName(best)
    # at most ``top`` rows per column
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value")))
    return leading.withColumn("position", place)


def profile_histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """(column, bin, n): equal-width bins between the extremes of each numeric column."""
    columns = list(columns) if columns else numeric_columns(df)
    ends = df.agg(
        *[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns]
    ).select(F.struct(*[F.col(c) for c in columns]).alias("ends")).scalar()
    bounded = df.select(*columns).withColumn("_ends", ends)

    def bin_of(c: str):
        lo, hi = F.col("_ends")[c]["lo"], F.col("_ends")[c]["hi"]
        width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
        return F.least(F.floor((F.col(c) - lo) / width).cast("int"), F.lit(bins - 1))

    items = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), bin_of(c)).alias("bin"))
            for c in columns
        ]
    )
    rows = bounded.select(F.inline(items)).filter(F.col("bin").isNotNull())
    return rows.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def profile_correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return correlations(df, list(columns) if columns else numeric_columns(df))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with their number of copies."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def profile_duplicates(df: DataFrame) -> DataFrame:
    """(n, duplicates, share): rows, rows that repeat an earlier one, and their share."""
    stand_ins = df.select(
        *[
            short_value(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
            for f in df.schema
        ]
    )
    counts = stand_ins.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    totals = counts.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
    )
    return totals.withColumn("share", F.try_divide(F.col("duplicates").cast("double"), F.col("n")))
