"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossgauge.sources.delimited import read_table

# the white space of all contracts here: space, tab, line feed, vertical tab, form feed, carriage return
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def lean_memory() -> None:
    """Give freed memory back to the system, now and for Arrow's buffers to come: a Python worker outlives its tasks, and
    what one operator held would stay with it beside the next."""
    import ctypes
    import gc

    import pyarrow

    pyarrow.set_memory_pool(pyarrow.system_memory_pool())
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents whose labels no model may see. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(texts: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """(id, text, label) of at most ``size`` documents outside the held-out fold, those with the least hashes of their ids.

    ``texts`` has id and text, ``marks`` id and label. One row per id: of several labels the largest, of several texts the
    one with the least hash, so that ids on many rows don't enlarge the sample. Null ids and labels are left out.
    """
    labels = (
        marks.where("id IS NOT NULL AND label IS NOT NULL")
        .where(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    present = labels.join(texts.select("id").distinct(), "id", "left_semi")
    chosen = present.orderBy(F.xxhash64("id"), "id").limit(size)
    order = F.struct(F.xxhash64("text"), F.col("text"))
    return texts.join(chosen, "id").groupBy("id").agg(F.min_by("text", order).alias("text"), F.max("label").alias("label"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for inner use: ``wanted``, made longer where ``df`` has such a column of its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null. The key columns of the right side are dropped."""
    inner = free_names(left, *[f"__right_{k}" for k in keys])
    renamed = right.withColumnsRenamed(dict(zip(keys, inner)))
    condition = None
    for k, other in zip(keys, inner):
        same = left[k].eqNullSafe(renamed[other])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*inner)
