"""Lines that many documents share, found batch by batch against levelled sorted runs of line hashes.

A run is a table of line hashes with the number of documents that hold each, sorted and bucketed by hash, so that runs
meet each other without a shuffle. A new batch of documents is reduced to such counts, merge-anti-joined with the lines
that earlier runs have already settled as frequent, and what is left becomes its own run on the lowest level. When a
level has ``fan`` runs, they are compacted into one run of the next level: counts of one line add up, and a line whose
count reaches the limit is settled, at the limit, as it needs no more counting. A last compaction of all levels leaves
the frequent lines.

Only DataFrame functions are used. A line travels as two 64-bit hashes of different seeds; the chance that any two of
10^13 different lines share both is below one in 10^12. A hot line is one row after the partial count on the map side.
Texts are never grouped: a document's dropped lines come back to it as positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossgauge.llm.common import null_safe_join, whole_text
from lossgauge.session import drop_buckets, sorted_buckets, stable

HASH = ["h1", "h2"]
ROW = ["doc_id", "t1", "t2"]
BLANK_CHARACTERS = " \t\n\x0b\f\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS = 10
BATCHES, FAN = 4, 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(line: Column) -> Column:
    """A line without blanks at its ends, A to Z in lower case. Other letters stay: only an all-ASCII line, which has as
    many bytes as characters, may go through the general lower-casing, which is the faster one."""
    bare = F.btrim(line, F.lit(BLANK_CHARACTERS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, CAPITALS, SMALL))


def two_hashes(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def _hashed(df: DataFrame, value: str, names: list[str]) -> DataFrame:
    return df.withColumns(dict(zip(names, two_hashes(F.col(value))))).drop(value)


def line_counts(docs: DataFrame, text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """(h1, h2, documents): how many rows of ``docs`` hold each line of at least ``least_chars`` characters."""
    keys = F.array_distinct(F.transform(lines_of(whole_text(text_col)), key_of))
    lines = docs.select(F.explode(keys).alias("key")).where(F.length("key") >= least_chars)
    return _hashed(lines, "key", HASH).groupBy(*HASH).agg(F.count(F.lit(1)).alias("documents"))


class LineRuns:
    """The levels of runs that batches of documents have left so far. Only names of tables are held here."""

    def __init__(self, spark: SparkSession, least_documents: int = LEAST_DOCUMENTS, fan: int = FAN):
        if fan < 2 or least_documents < 1:
            raise ValueError("compaction takes two runs at least, and a line one document")
        self.spark, self.least_documents, self.fan = spark, least_documents, fan
        self.levels: list[list[str]] = []
        self.passing: list[str] = []

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def add(self, counts: DataFrame) -> None:
        """Count a batch of documents in, given as (h1, h2, documents) with one row per line."""
        fresh = counts
        for run in self.runs():
            settled = self.spark.table(run).where(F.col("documents") >= self.least_documents)
            fresh = fresh.join(settled.hint("merge"), HASH, "left_anti")
        self._put(0, fresh)

    def _put(self, level: int, counts: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        full = [*self.levels[level], self._store(counts)]
        self.levels[level] = full if len(full) < self.fan else []
        if len(full) == self.fan:
            self._put(level + 1, self._merged(full))
            drop_buckets(self.spark, full)

    def _store(self, counts: DataFrame) -> str:
        # more than the limit is no further news
        enough = F.least("documents", F.lit(self.least_documents).cast("long"))
        return sorted_buckets(counts.select(*HASH, enough.alias("documents")), HASH)

    def _merged(self, runs: Sequence[str]) -> DataFrame:
        """The counts of several runs added up: two runs at a time are merge-joined, bucket by bucket. (After a union of
        bucketed tables Spark 4.1 may group without a shuffle and yet read them out of their buckets.)"""
        rows = self.spark.table(runs[0])
        for i, run in enumerate(runs[1:]):
            if i:
                between = self._store(rows)
                rows = self.spark.table(between)
                self.passing.append(between)
            other = self.spark.table(run).withColumnRenamed("documents", "more").hint("merge")
            both = F.coalesce("documents", F.lit(0)) + F.coalesce("more", F.lit(0))
            rows = rows.join(other, HASH, "full_outer").select(*HASH, both.cast("long").alias("documents"))
        return rows

    def close(self) -> DataFrame:
        """(h1, h2) of all lines that at least ``least_documents`` documents hold, stored. The runs are given up."""
        merged = self._merged(self.runs()).where(F.col("documents") >= self.least_documents)
        found = stable(merged.select(*HASH))
        drop_buckets(self.spark, [*self.runs(), *self.passing])
        self.levels, self.passing = [], []
        return found


def batches_of_files(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """A table that was just read, as batches by file name: Spark leaves out the files of other batches unread."""
    batches = max(1, min(batches, len(docs.inputFiles())))
    batch = F.pmod(F.xxhash64("_metadata.file_name"), F.lit(batches))
    return [docs.where(batch == i) for i in range(batches)]


def common_lines(
    batches: Sequence[DataFrame],
    text_col: str = "text",
    least_documents: int = LEAST_DOCUMENTS,
    least_chars: int = 1,
    fan: int = FAN,
) -> DataFrame:
    """(h1, h2) of the lines that at least ``least_documents`` rows of all batches together hold."""
    runs = LineRuns(batches[0].sparkSession, least_documents, fan)
    for batch in batches:
        runs.add(line_counts(batch, text_col, least_chars))
    return runs.close()


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_documents: int = LEAST_DOCUMENTS,
    least_chars: int = 1,
    batches: Sequence[DataFrame] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept), one row per row of ``docs``: the text without the lines that at least
    ``least_documents`` rows share, the other lines joined by line feeds.

    Lines are equal if they are after blanks at both ends are gone and A to Z is in lower case; what is then shorter
    than ``least_chars`` characters stays. A line counts once per row that holds it. ``batches`` are parts that make up
    ``docs``, taken one after the other; without them ``docs`` is one batch. The split changes no result.

    Null and empty texts have one empty line. Each row counts as a document, also if it repeats an id or another row;
    a null doc_id is carried, other columns are ignored, an empty table gives an empty result.
    """
    common = common_lines(batches or [docs], text_col, least_documents, least_chars, fan)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumns(dict(zip(ROW[1:], two_hashes(F.col("text")))))
    keys = F.transform(lines_of(F.col("text")), key_of)
    lines = rows.select(*ROW, F.posexplode(keys).alias("at", "key")).where(F.length("key") >= least_chars)
    hits = _hashed(lines, "key", HASH).join(common, HASH, "left_semi")
    # stored, so that the join below can be split where one row has very many copies
    dropped = stable(hits.groupBy(*ROW).agg(F.collect_set("at").alias("dropped")))
    marked = null_safe_join(rows, dropped, ROW, "left")

    def without(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
        return F.array_join(F.transform(places, lambda at: F.get(lines, at)), "\n")

    # a lambda's argument is split once, not once per line
    rest = F.transform(F.array(lines_of(F.col("text"))), without)[0]
    n_dropped = F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped"))
    return marked.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(rest).alias("kept"),
    )
