"""Fill-in-middle: texts cut at token bounds into prefix, middle and suffix, the middle moved to the end.

The bounds of a text's tokens are a set of code-point offsets, kept as compressed bitmaps are: offsets with the same high
16 bits share a container, which is the smallest of a sorted array, a bitmap, or a list of runs, and cumulative
cardinalities over the containers find the one that holds the k-th bound. A local select there gives the offset. The set
of a text is built and asked within its row; the cutting, the marks and the way back are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgauge.llm.common import lean_memory, whole_text

MARKS = ("<P>", "<S>", "<M>")
CONTAINER = 1 << 16
# bytes of a bitmap; an array takes 2 bytes an element, a run 4
BITMAP_BYTES = CONTAINER // 8


class ArrayContainer:
    """Few values: sorted 16-bit numbers."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """Many scattered values: one bit each, with the number of bits before each 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CONTAINER, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # drops the lowest bit
        return 64 * at + (word & -word).bit_length() - 1


class RunContainer:
    """Values in stretches: first value of each, with the number of values before it."""

    def __init__(self, firsts: np.ndarray, lengths: np.ndarray):
        self.firsts = firsts.astype(np.uint16)
        self.before = np.cumsum(lengths) - lengths

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.firsts[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted, distinct values below 65,536."""
    fresh = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
    array, runs = 2 * len(low), 4 * len(fresh)
    if runs < min(array, BITMAP_BYTES):
        return RunContainer(low[fresh], np.diff(fresh, append=len(low)))
    return ArrayContainer(low) if array <= BITMAP_BYTES else BitmapContainer(low)


class BoundarySet:
    """A set of offsets that answers which is the k-th, from 0."""

    def __init__(self, offsets: np.ndarray):
        """``offsets`` are sorted and distinct."""
        high = offsets >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[starts]
        self.before = starts  # values in the containers before
        self.containers = [container(part & 0xFFFF) for part in np.split(offsets, starts[1:])]
        self.size = len(offsets)

    def select(self, k: int) -> int:
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.high[at]) << 16) + self.containers[at].select(k - int(self.before[at]))


def token_bounds(text: str) -> np.ndarray:
    """Offsets at which tokens ``[A-Za-z]+|[^A-Za-z]`` begin or end, in code points: 0, and the end of each token."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = (points | 0x20) - np.uint32(ord("a")) < 26
    inner = np.flatnonzero(~(letter[:-1] & letter[1:])) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def cuts(text: Column, one: Column, other: Column) -> Column:
    """Number of tokens of a text, and the offsets of the bounds that two numbers name, modulo the number of bounds."""

    @F.pandas_udf("n long, first long, second long")
    def select(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        lean_memory()
        for texts, ones, others in batches:
            rows = np.empty((len(texts), 3), np.int64)
            for i, (t, a, b) in enumerate(zip(texts, ones, others)):
                bounds = BoundarySet(token_bounds(t))
                low, high = sorted((a % bounds.size, b % bounds.size))
                rows[i] = bounds.size - 1, bounds.select(low), bounds.select(high)
            yield pd.DataFrame(rows, columns=["n", "first", "second"])

    return select(text, one, other)


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a document, the same in every run. A null id counts as the text ''."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(named.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    percent: int = 90,
    suffix_first_percent: int = 20,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    n is the number of tokens. ``percent`` of the texts are cut, of these ``suffix_first_percent`` have the suffix first:
    form 'psm' is mark 1, prefix, mark 2, suffix, mark 3, middle; 'spm' is mark 2, suffix, mark 1, prefix, mark 3,
    middle. The others, empty texts, and texts that hold a mark have form 'plain': the text as it is, the two lengths
    (in code points) null. Both cuts are bounds of tokens, drawn from the id and the seed.

    Null text counts as empty, a null id as the text ''. Rows with one id are cut by the same numbers; repeated rows
    repeat, other columns are ignored, an empty table gives an empty result.
    """
    first_mark, second_mark, third_mark = map(F.lit, marks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    one, other, whether, which = draws(F.col("doc_id"), seed)
    cut = rows.select("doc_id", "text", cuts(F.col("text"), one, other).alias("cut"))
    marked = F.lit(False)
    for mark in marks:
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (whether % 100 >= percent)
    form = F.when(plain, "plain").when(which % 100 < suffix_first_percent, "spm").otherwise("psm")
    a, b = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.substring("text", F.lit(1), a)
    middle = F.substring("text", a + 1, b - a)
    suffix = F.substring("text", b + 1, F.lit((1 << 31) - 1))
    shaped = cut.select("doc_id", "text", "cut", form.alias("form"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(first_mark, prefix, second_mark, suffix, third_mark, middle))
        .otherwise(F.concat(second_mark, suffix, first_mark, prefix, third_mark, middle))
    )
    cut_only = F.col("form") != "plain"
    return shaped.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(cut_only, F.col("cut.first")).alias("prefix_chars"),
        F.when(cut_only, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from. No mark occurs in a text that was cut, so each is found by
    its place."""
    parts = F.split(output, "|".join("\\Q" + m + "\\E" for m in marks), -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )
