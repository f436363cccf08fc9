"""Wide and long forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str] | None, variable: str, value: str
) -> DataFrame:
    """One row per id and value column, NULL values kept. Without ``values``: all other columns."""
    values = list(values) if values else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, variable, value)


def long_to_wide(
    df: DataFrame, ids: Sequence[str], key: str, value: str, labels: Sequence[str], unique: bool = True
) -> DataFrame:
    """One column per label. With ``unique``, two rows for one cell are an error."""
    cell = F.max(value)
    if unique:
        message = F.lit(f"more than one row per {', '.join(ids)} and {key}")
        cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(message)).otherwise(cell)
    return df.groupBy(*ids).pivot(key, list(labels)).agg(cell)


def stack_years(
    df: DataFrame,
    *,
    entity: str,
    series: str,
    years: Mapping[str, int],
    labels: Sequence[str],
    unique: bool = True,
) -> DataFrame:
    """(entity, series) rows with one column per year to (entity, year) rows with one column per series.

    One scan: unpivot the years, then pivot the series.
    """
    year = F.lit(None).cast("int")
    for column, number in years.items():
        year = F.when(F.col("_column") == column, F.lit(number)).otherwise(year)
    long = df.unpivot([entity, series], list(years), "_column", "_value")
    long = long.select(entity, series, year.alias("year"), "_value")
    return long_to_wide(long, [entity, "year"], series, "_value", labels, unique)


def one_hot(df: DataFrame, column: str, labels: Sequence[str], keep_source: bool = False) -> DataFrame:
    """One 0/1 column per label, named ``column_label``."""
    encoded = df.withColumns(
        {f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in labels}
    )
    return encoded if keep_source else encoded.drop(column)
