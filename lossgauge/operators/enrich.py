"""Joins between facts, dimensions and rename tables.

No broadcast hint is given. Spark broadcasts a side whose size, from file statistics or measured at run
time, is under ``spark.sql.autoBroadcastJoinThreshold``; a larger side goes through a shuffled join, where
adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_dimension(fact: DataFrame, dimension: DataFrame, fact_key: str, dimension_key: str) -> DataFrame:
    """Inner join on differently named keys; the dimension's key is left out of the result."""
    if fact_key == dimension_key:
        return fact.join(dimension, fact_key, "inner")
    return fact.join(dimension, fact[fact_key] == dimension[dimension_key], "inner").drop(dimension[dimension_key])


def unmatched(fact: DataFrame, dimension: DataFrame, fact_key: str, dimension_key: str) -> DataFrame:
    """(fact_key, n): keys that the inner join would lose, NULL among them, and how many rows each has."""
    counts = fact.groupBy(fact_key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(dimension, counts[fact_key] == dimension[dimension_key], "left_anti")


def join_facts(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    """Inner join of two facts on key lists of equal length; both key sets stay."""
    pairs = [left[a] == right[b] for a, b in zip(left_on, right_on, strict=True)]
    return left.join(right, pairs, "inner")


def reattach(densified: DataFrame, measured: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Swap a carried-forward measure for the measured one; rows without a measurement go."""
    return densified.drop(measure).join(measured.select(*keys, measure), list(keys), "inner")


def lookup_rename(df: DataFrame, column: str, renames: DataFrame, old: str, new: str) -> DataFrame:
    """Replace ``column`` by its entry in a rename table; a miss becomes NULL.

    If a name has several entries, the greatest new name counts.
    """
    table = renames.groupBy(F.col(old).alias("_old")).agg(F.max(new).alias("_new"))
    joined = df.join(table, df[column] == table["_old"], "left")
    return joined.select(*[F.col("_new").alias(c) if c == column else df[c] for c in df.columns])


def _shortened(names: DataFrame, name: str, most: int) -> DataFrame:
    """(name, _form): each name with every form of it that lacks up to ``most`` characters."""
    forms = F.array(F.lower(name))
    for _ in range(most):
        fewer = F.flatten(
            F.transform(
                "_forms",
                lambda s: F.when(
                    F.length(s) > 0,
                    F.transform(
                        F.sequence(F.lit(1), F.length(s)),
                        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
                    ),
                ).otherwise(F.array(F.lit("").cast("string"))),
            )
        )
        names = names.withColumn("_forms", forms)
        forms = F.array_distinct(F.concat("_forms", fewer))
    return names.select(name, F.explode(forms).alias("_form"))


def suggest_names(lost: DataFrame, known: DataFrame, name: str, known_name: str, most: int = 2) -> DataFrame:
    """(name, candidate, distance): known names within ``most`` edits of a lost one, upper and lower case being equal.

    Two names that few edits part have a common form that lacks as many characters at most on either side. So the names
    meet by an equi-join on such forms, and the distance of those that meet is verified: no candidate is missed, and no
    name is compared with all others. A NULL name has none.
    """
    left = _shortened(lost.filter(F.col(name).isNotNull()).select(F.col(name).alias("_lost")).distinct(), "_lost", most)
    right = _shortened(known.filter(F.col(known_name).isNotNull()).select(F.col(known_name).alias("_known")).distinct(), "_known", most)
    met = left.join(right, "_form").select("_lost", "_known").distinct()
    distance = F.levenshtein(F.lower("_lost"), F.lower("_known"), most)
    checked = met.withColumn("distance", distance).filter(F.col("distance") >= 0)
    return checked.select(F.col("_lost").alias(name), F.col("_known").alias("candidate"), "distance")
