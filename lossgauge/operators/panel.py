"""Entity-year panels: last value per year, missing years, fill, measured values back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgauge.operators.enrich import reattach
from lossgauge.operators.ordered import forward_fill


def resample_last(
    df: DataFrame, *, entity: str, year: str, order_by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """One row per entity and year with the last non-null value of every column.

    ``order_by`` says which row of a year comes last.
    """
    # a single order column keeps the aggregation hash-based for numbers
    position = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    known = df.filter(F.col(entity).isNotNull() & F.col(year).isNotNull())
    return known.groupBy(entity, year).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in columns]
    )


def densify_years(df: DataFrame, *, entity: str, year: str) -> DataFrame:
    """Add the years missing between the first and last year of each entity, with NULLs.

    The input has one row per entity and year.
    """
    span = df.groupBy(entity).agg(F.min(year).alias("_first"), F.max(year).alias("_last"))
    years = span.select(entity, F.explode(F.sequence("_first", "_last")).alias(year))
    return years.join(df, [entity, year], "left")


def densify_and_reattach(
    df: DataFrame,
    measured: DataFrame,
    *,
    entity: str,
    year: str,
    order_by: Sequence[str],
    columns: Sequence[str],
    keys: Sequence[str],
    measure: str,
    fill_across: bool = False,
) -> DataFrame:
    """Resample, add missing years, fill forward, then join the measured values back on ``keys``.

    The fill stays within an entity. ``fill_across=True`` lets it run on from one entity to the next.
    """
    yearly = resample_last(df, entity=entity, year=year, order_by=order_by, columns=columns)
    dense = densify_years(yearly, entity=entity, year=year)
    if fill_across:
        filled = forward_fill(dense, columns, order_by=[entity, year])
    else:
        filled = forward_fill(dense, columns, partition_by=[entity], order_by=[year], bounded=True)
    return reattach(filled, measured, keys, measure)
