"""Row layout for filters on several columns: rows close in all of them share files, so that a filter on any skips most.

The key of a row interleaves the bits of its places in the columns (Z-order). A place is the rank of the value, cut to
equal shares of the rows, so that frequent and rare values use the key's bits alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgauge.operators.ordered import GROUP_LIMIT, running_total
from lossgauge.session import stable

BITS = 8


def places(df: DataFrame, column: str, bits: int = BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(column, _place): each value with the share of rows before it, from 0 to 2^bits - 1; NULL is first.

    Rows collapse to values with counts before the shuffle. Equal values have one place, so it never parts them.
    """
    counts = stable(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0)))
    upto = running_total(
        counts, partition_by=["_all"], order_by=[column], name="_upto", weight="_n", group_limit=group_limit
    )
    rows = counts.agg(F.sum("_n")).scalar()
    place = F.floor((F.col("_upto") - F.col("_n")).cast("double") / rows * 2**bits).cast("long")
    return stable(upto.select(column, place.alias("_place")))


def interleaved(codes: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of several codes by turns, the highest first, as one long."""
    if bits * len(codes) > 62:
        raise ValueError("the key has 62 bits")
    key = F.lit(0).cast("long")
    for bit in range(bits):
        for i, code in enumerate(codes):
            one = F.shiftright(code, bit).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(one, bit * len(codes) + len(codes) - 1 - i))
    return key


def z_ordered(df: DataFrame, columns: Sequence[str], files: int, bits: int = BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``df`` in ``files`` partitions by ranges of the interleaved key, sorted by it: ready to be written.

    The values' places are joined by value, without a hint: few values are broadcast, many are not.
    """
    marked = df
    for i, c in enumerate(columns):
        table = places(df, c, bits, group_limit).select(F.col(c).alias(f"_v{i}"), F.col("_place").alias(f"_p{i}"))
        marked = marked.join(table, marked[c].eqNullSafe(table[f"_v{i}"]), "left").drop(f"_v{i}")
    key = interleaved([F.col(f"_p{i}") for i in range(len(columns))], bits)
    ranged = marked.withColumn("_key", key).repartitionByRange(files, "_key").sortWithinPartitions("_key")
    return ranged.select(*df.columns)


def write_z_ordered(df: DataFrame, path: str, columns: Sequence[str], files: int, bits: int = BITS) -> None:
    """Store ``df`` as parquet whose files and row groups hold narrow ranges of each of ``columns``."""
    z_ordered(df, columns, files, bits).write.parquet(path)
