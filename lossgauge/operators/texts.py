"""What the text columns of a table are made of: characters, categories, scripts and lengths.

Each Arrow batch is reduced to a histogram of its characters before anything is shuffled; a row per character never
exists. Categories and scripts are looked up for the distinct characters only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# tasks get these helpers by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# General categories and some scripts of the Unicode standard.
CATEGORIES = (
    "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Co"
).split()
SCRIPTS = (
    "Common Inherited Latin Greek Cyrillic Armenian Hebrew Arabic Devanagari Bengali Tamil Thai Georgian Hangul Hiragana "
    "Katakana Han"
).split()
CHARACTERS_AT_ONCE = 4_000_000


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def _histogram(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    counts = np.bincount(points)
    codes = np.flatnonzero(counts)
    return codes, counts[codes]


def _pieces(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, in lists of about ``CHARACTERS_AT_ONCE``."""
    held, size = [], 0
    for value in column:
        text = value.as_py()
        if text:
            held.append(text)
            size += len(text)
        if size >= CHARACTERS_AT_ONCE:
            yield held
            held, size = [], 0
    yield held


def character_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, character, n, category, script) of all characters of whole texts.

    ``category`` is the general category, ``script`` one of ``SCRIPTS``; what is in none of them is 'other'.
    """
    columns = list(columns or text_columns(df))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, column in zip(columns, batch.columns):
                for texts in _pieces(column):
                    codes, counts = _histogram(texts)
                    arrays = [pa.array([name] * len(codes), pa.string()), pa.array([chr(c) for c in codes], pa.string())]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], names=["column", "character", "n"])

    partial = df.select(*columns).mapInArrow(count, "column string, character string, n long")
    counted = partial.groupBy("column", "character").agg(F.sum("n").alias("n"))

    def kind(names: Sequence[str], prefix: str) -> Column:
        found = [F.when(F.col("character").rlike(rf"\p{{{prefix}{name}}}"), name) for name in names]
        return F.coalesce(*found, F.lit("other"))

    return counted.withColumns({"category": kind(CATEGORIES, ""), "script": kind(SCRIPTS, "Is")})


def script_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, script, characters, n, share): distinct characters and occurrences per script."""
    sums = character_counts(df, columns).groupBy("column", "script").agg(
        F.count(F.lit(1)).alias("characters"), F.sum("n").alias("n")
    )
    totals = sums.groupBy("column").agg(F.sum("n").alias("_total"))
    return sums.join(totals, "column").withColumn("share", F.col("n").cast("double") / F.col("_total")).drop("_total")


def length_histogram(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, at_least, n, characters, words): texts by length in characters, in bins that double in width.

    ``at_least`` is 0 for empty texts, else the greatest power of two that the length reaches. Words are separated by
    blanks. NULL texts are left out.
    """
    columns = list(columns or text_columns(df))

    def measures(c: str) -> Column:
        return F.struct(
            F.lit(c).alias("column"),
            F.length(c).cast("long").alias("length"),
            F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        )

    rows = df.select(F.inline(F.array(*[measures(c) for c in columns]))).filter(F.col("length").isNotNull())
    # by binary digits: a logarithm may fall just short of a power of two
    power = F.pow(F.lit(2.0), F.length(F.bin("length")) - 1)
    at_least = F.when(F.col("length") > 0, power).otherwise(F.lit(0.0))
    return rows.groupBy("column", at_least.cast("long").alias("at_least")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("characters"), F.sum("words").alias("words")
    )
