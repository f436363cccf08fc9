"""The parts of a table profile that look at several columns, or into texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lossgauge.operators import association, missing, texts
from lossgauge.operators.summarize import numeric_columns


def associations(rows: DataFrame) -> dict[str, DataFrame]:
    """Rank correlation and Kendall's tau of the numbers, Cramér's V of the texts, missing values, and text statistics."""
    numbers, words = numeric_columns(rows), texts.text_columns(rows)
    found = {"missing patterns": missing.missing_patterns(rows)}
    if len(rows.columns) > 1:
        found["missing correlation"] = missing.missing_correlation(rows)
        found["missing clusters"] = missing.missing_clusters(rows)
    if len(numbers) > 1:
        found["rank correlation"] = association.rank_correlations(rows, numbers)
        found["kendall"] = association.kendall_correlations(rows, numbers)
    if len(words) > 1:
        found["text association"] = association.text_association(rows, words)
    if words:
        found["characters"] = texts.character_counts(rows, words)
        found["scripts"] = texts.script_counts(rows, words)
        found["lengths"] = texts.length_histogram(rows, words)
    return found
