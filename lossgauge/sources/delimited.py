"""Typed reading of delimited text, and the parquet side of sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossgauge.functions.scalar import MISSING_MARKERS, blank_markers, to_whole_number


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    types: Mapping[str, str] | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    multiline: bool = False,
    markers: Iterable[str] = MISSING_MARKERS,
) -> DataFrame:
    """Read a delimited file with a header.

    Columns are found by name and are text unless ``types`` says otherwise; columns not named there pass
    through as text. Missing markers become NULL, and unreadable numbers too. No schema inference: types
    do not depend on the rows. ``multiline`` admits quoted line breaks; such a file is read by one
    task, so it is meant for catalogues, not for facts. Latin-1 is called ``ISO-8859-1`` here.
    """
    raw = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    types, markers = types or {}, list(markers)
    columns = []
    for name in raw.columns:
        # backticks: a header may hold a dot
        col = blank_markers(F.col(f"`{name}`"), markers)
        kind = types.get(name, "string")
        if kind == "int":
            col = to_whole_number(col)
        elif kind != "string":
            col = F.trim(col).try_cast(kind)
        columns.append(col.alias(name))
    return raw.select(*columns)


REJECTED = "_rejected_line"


def read_delimited_checked(
    spark: SparkSession,
    path: str,
    *,
    types: Mapping[str, str] | None = None,
    names: Sequence[str] | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    multiline: bool = False,
    markers: Iterable[str] = MISSING_MARKERS,
) -> tuple[DataFrame, DataFrame]:
    """``read_delimited`` that keeps what it can't read: (good rows, rejected rows).

    Rejected are records with too few or too many fields, and records with a text that is neither a missing marker nor
    of its column's type. They come as (line, fields, reason): the raw record where its fields don't fit, else NULL; the
    fields that were found, by column; and why. Each record is in just one of the two tables. ``names`` is for files
    without a header.
    """
    options = {"sep": sep, "encoding": encoding, "multiLine": multiline, "quote": '"', "escape": '"'}
    header = names is None
    names = list(names or spark.read.options(header=True, **options).csv(path).columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, REJECTED]])
    raw = (
        spark.read.schema(schema)
        # all columns are parsed in any query, so that a record is judged alike in all
        .options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED, columnPruning=False, **options)
        .csv(path)
    )
    types, markers = types or {}, list(markers)
    typed, unreadable = [], []
    for name in names:
        known = blank_markers(F.col(f"`{name}`"), markers)
        kind = types.get(name, "string")
        value = known
        if kind == "int":
            value = to_whole_number(known)
        elif kind != "string":
            value = F.trim(known).try_cast(kind)
        typed.append(value.alias(name))
        if kind != "string":
            unreadable.append(F.when(known.isNotNull() & value.isNull(), F.lit(name)))
    line = F.col(REJECTED)
    bad = F.array_compact(F.array(*unreadable)) if unreadable else F.array().cast("array<string>")
    reason = F.when(line.isNotNull(), "wrong number of fields").when(
        F.size(bad) > 0, F.concat(F.lit("unreadable: "), F.array_join(bad, ", "))
    )
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))
    good = raw.filter(reason.isNull()).select(*typed)
    rejected = raw.filter(reason.isNotNull()).select(line.alias("line"), fields.alias("fields"), reason.alias("reason"))
    return good, rejected


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Store the rows a filter left, as parquet."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
