"""Row cleaning: duplicates, lists, ranges, text matches, null rules and renames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgauge.functions.scalar import blank_markers, clean_text, map_values, nan_to_null, to_number

ALL = "All"


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates, NULL equal to NULL."""
    return df.dropDuplicates()


def keep_values(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """Allow-list. NULL is not on any list."""
    return df.filter(F.col(column).isin(list(allowed)))


def keep_listed(df: DataFrame, column: str, allowed: DataFrame, key: str) -> DataFrame:
    """Allow-list given as a table, of any length."""
    listed = allowed.select(F.col(key).alias(column)).distinct()
    return df.join(listed, column, "left_semi")


def drop_values(df: DataFrame, column: str, denied: Iterable[str]) -> DataFrame:
    """Deny-list that keeps NULL rows, as ``!=`` does on a data frame."""
    return df.filter(~F.coalesce(F.col(column).isin(list(denied)), F.lit(False)))


def drop_group(df: DataFrame, column: str, label: str) -> DataFrame:
    """Leave out one labelled group; no error if it is absent."""
    return drop_values(df, column, [label])


def keep_matching(df: DataFrame, column: str, text: str, regex: bool = False) -> DataFrame:
    """Substring or pattern match; NULL does not match."""
    match = F.col(column).rlike(text) if regex else F.col(column).contains(text)
    return df.filter(F.coalesce(match, F.lit(False)))


def keep_positive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)


def keep_negative(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) < 0)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Leave out rows with a NULL in any (listed) column."""
    return df.dropna("any", subset=list(columns) if columns else None)


def panel_condition(
    *,
    equal: Mapping[str, object] | None = None,
    member: Mapping[str, Iterable[object]] | None = None,
    between: Mapping[str, tuple[object, object]] | None = None,
) -> Column:
    """One predicate for a filter panel. ``'All'`` or ``None`` in ``equal`` means no filter."""
    condition = F.lit(True)
    for column, value in (equal or {}).items():
        if value is not None and value != ALL:
            condition = condition & (F.col(column) == F.lit(value))
    for column, values in (member or {}).items():
        condition = condition & F.col(column).isin(list(values))
    for column, (low, high) in (between or {}).items():
        condition = condition & F.col(column).between(low, high)
    return condition


def filter_panel(df: DataFrame, **choices) -> DataFrame:
    return df.filter(panel_condition(**choices))


def replace_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Exact value replacement; values without a rule stay."""
    return df.withColumn(column, map_values(F.col(column), mapping))


def blank_missing(df: DataFrame, columns: Sequence[str], markers: Iterable[str]) -> DataFrame:
    markers = list(markers)
    return df.withColumns({c: blank_markers(F.col(c), markers) for c in columns})


def numbers_from_text(df: DataFrame, columns: Sequence[str], markers: Iterable[str] = ("..",)) -> DataFrame:
    markers = list(markers)
    return df.withColumns({c: to_number(F.col(c), markers) for c in columns})


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every float and double column, so that means and counts skip it."""
    floats = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats})


def trim_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clean_text(F.col(c)) for c in columns})


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """New names by position."""
    return df.toDF(*names)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
