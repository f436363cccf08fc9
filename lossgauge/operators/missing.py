"""The structure of missing values: patterns, their correlation, and the columns that are missing together.

One pass over the rows counts the patterns; the rest works on their counts.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# tasks get these helpers by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MERGES = "array<struct<step: int, first: array<int>, second: array<int>, distance: double>>"


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(pattern, n_missing, n, share): which columns are NULL together, and in how many rows.

    A pattern has one character per column in the given order, 1 for missing and 0 for known.
    """
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns or df.columns])
    counts = df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.agg(F.sum("n")).scalar()
    n_missing = F.length(F.replace("pattern", F.lit("0"), F.lit(""))).alias("n_missing")
    return counts.select("pattern", n_missing, "n", (F.col("n").cast("double") / rows).alias("share"))


def _pair_sums(patterns: DataFrame, n_columns: int, together) -> list[Column]:
    """For each pair of columns the number of rows whose two marks fulfil ``together``."""
    mark = [F.substring("pattern", i + 1, 1) == "1" for i in range(n_columns)]
    some = [together(mark[i], mark[j]) for i, j in combinations(range(n_columns), 2)]
    return [F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).cast("double") for x in some]


def missing_correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, corr): correlation of being missing, for all pairs of different columns, both ways.

    A column that is never or always missing gives NULL.
    """
    columns = list(columns or df.columns)
    patterns = missing_patterns(df, columns)
    alone = [
        F.coalesce(F.sum(F.when(F.substring("pattern", i + 1, 1) == "1", F.col("n"))), F.lit(0)).cast("double").alias(f"_m{i}")
        for i in range(len(columns))
    ]
    both = [c.alias(f"_b{i}") for i, c in enumerate(_pair_sums(patterns, len(columns), lambda x, y: x & y))]
    sums = patterns.agg(F.sum("n").cast("double").alias("_n"), *alone, *both)
    n, cells = F.col("_n"), []
    for k, (i, j) in enumerate(combinations(range(len(columns)), 2)):
        a, b = F.col(f"_m{i}"), F.col(f"_m{j}")
        # shares rather than counts, whose products would run out of digits
        cover = F.col(f"_b{k}") / n - (a / n) * (b / n)
        corr = F.try_divide(cover, F.sqrt(a / n * (1 - a / n) * (b / n) * (1 - b / n)))
        cells += [(columns[i], columns[j], corr), (columns[j], columns[i], corr)]
    known = sums.filter(F.col("_n") > 0)
    return known.select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.alias("corr")) for a, b, c in cells]))
    )


def average_linkage(distances: Sequence[float], n: int) -> list[tuple[int, list[int], list[int], float]]:
    """The merges of ``n`` items into one tree, nearest clusters first: (step, items, items, distance).

    ``distances`` are those of the pairs (0, 1), (0, 2), ..., (n-2, n-1). The distance of clusters is the mean over their
    items; on a tie the clusters with the smallest items merge first.
    """
    place = {pair: d for pair, d in zip(combinations(range(n), 2), distances)}
    clusters = {i: [i] for i in range(n)}
    merges = []
    for step in range(1, n):
        distance, i, j = min((d, i, j) for (i, j), d in place.items())
        a, b = clusters[i], clusters.pop(j)
        merges.append((step, a, b, distance))
        clusters[i] = sorted(a + b)
        del place[i, j]
        for k in clusters:
            if k != i:
                one, other = (min(i, k), max(i, k)), (min(j, k), max(j, k))
                place[one] = (place[one] * len(a) + place.pop(other) * len(b)) / (len(a) + len(b))
    return merges


def missing_clusters(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(step, first, second, distance): columns merged by average linkage into groups that are missing together.

    The distance of two columns is the root of the number of rows in which just one of them is missing. ``first`` and
    ``second`` list the columns of the merged groups, in the given order; ``first`` holds the earliest column of both.
    """
    columns = list(columns or df.columns)
    patterns = missing_patterns(df, columns)
    apart = [F.sqrt(c) for c in _pair_sums(patterns, len(columns), lambda x, y: x != y)]
    n = len(columns)

    def linkage(rows: pd.Series) -> pd.Series:
        fields = ("step", "first", "second", "distance")
        return pd.Series([[dict(zip(fields, m)) for m in average_linkage(list(row), n)] for row in rows])

    merged = patterns.agg(F.array(*apart).alias("d")).select(F.inline(F.pandas_udf(linkage, MERGES)("d")))
    listed = F.array(*[F.lit(c) for c in columns])

    def names(places: str) -> Column:
        return F.transform(places, lambda i: F.get(listed, i)).alias(places)

    return merged.select("step", names("first"), names("second"), "distance")
