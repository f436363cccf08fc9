"""Quality rules with repetition measured on a suffix array of words.

The suffix array of a batch of documents is built by prefix doubling, in which only suffixes that still share their
first words with another are sorted again. Longest common prefixes of neighbours come from the ranks of the doubling
steps. A suffix whose prefix with a neighbour has l words starts a repeated substring of l words: the spans of all
maximal repeats are united into one cover, and the longest of them is kept. Everything runs on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgauge.llm.common import lean_memory, whole_text

SYMBOLS = "#*$%&|<>"
BLANK_CHARACTERS = " \t\n\v\f\r"
# repeats shorter than this are ordinary phrases
LEAST_REPEAT = 8
# of a clean text, repeats cover at most this share of the words, and no repeat is longer than this many words
MOST_COVERED = 0.3
LONGEST_REPEAT = 100
LEAST_WORDS = 50
WORDS_AT_ONCE = 150_000

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "covered_words long, longest_repeat long, kept boolean"
)


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring there that occurs elsewhere in its document.

    ``words`` holds the documents' word numbers one after the other, ``ends`` for each position the end of its
    document. A word number stands for one word of one document, so documents never match each other.
    """
    n = len(words)
    repeat = np.zeros(n, np.int64)
    if n == 0:
        return repeat
    suffixes = np.argsort(words, kind="stable")
    ordered = words[suffixes]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[suffixes] = starts[np.cumsum(fresh) - 1]
    steps, width = [rank.copy()], 1
    sizes = np.diff(np.append(starts, n))
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of suffixes that share their first words
    while len(slots):
        active = suffixes[slots]
        after = active + width
        inside = after < ends[active]
        second = np.where(inside, rank[np.where(inside, after, 0)], -1)
        first = rank[active]
        order = np.lexsort((second, first))
        active, first, second = active[order], first[order], second[order]
        suffixes[slots] = active
        new_group = np.concatenate([[True], first[1:] != first[:-1]])
        fresh = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        starts = np.flatnonzero(fresh)
        rank[active] = slots[starts][np.cumsum(fresh) - 1]
        steps.append(rank.copy())
        width *= 2
        sizes = np.diff(np.append(starts, len(slots)))
        slots = slots[np.repeat(sizes > 1, sizes)]
    left, right = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(steps[0][left] == steps[0][right])
    left, right = left[pairs], right[pairs]
    common = np.zeros(len(pairs), np.int64)
    for step in range(len(steps) - 1, -1, -1):
        i, j = left + common, right + common
        inside = (i < ends[left]) & (j < ends[right])
        same = inside & (steps[step][np.where(inside, i, 0)] == steps[step][np.where(inside, j, 0)])
        common += same.astype(np.int64) << step
    np.maximum.at(repeat, left, common)
    np.maximum.at(repeat, right, common)
    return repeat


def covered(repeat: np.ndarray, least: int, exactly: int | None = None) -> np.ndarray:
    """Positions inside a repeat of at least ``least`` words; each repeat counts with all its words, or the first few."""
    at = np.flatnonzero(repeat >= least)
    change = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + (exactly if exactly else repeat[at]), -1)
    return np.cumsum(change[:-1]) > 0


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


def _repetition(numbers: list[np.ndarray], least_repeat: int) -> list[tuple[int, int, int]]:
    """(words in repeated 3-word windows, words covered by repeats, longest repeat) of each document."""
    lengths = np.array([len(x) for x in numbers], np.int64)
    if lengths.sum() == 0:
        return [(0, 0, 0)] * len(numbers)
    document = np.repeat(np.arange(len(numbers)), lengths)
    words = np.concatenate(numbers) + document * (1 << 32)
    bounds = np.cumsum(lengths)
    repeat = longest_repeats(words, bounds[document])
    out = []
    three = np.bincount(document, covered(repeat, 3, 3), len(numbers))
    cover = np.bincount(document, covered(repeat, least_repeat), len(numbers))
    longest = np.zeros(len(numbers), np.int64)
    np.maximum.at(longest, document, repeat)
    for row in zip(three, cover, longest):
        out.append(tuple(int(x) for x in row))
    return out


def _measures(texts, least_repeat: int):
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, and the three of ``_repetition``."""
    seen, rows, numbers, held = _Numbers(), [], [], 0
    for text in texts:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at the six blanks only
        n = len(words)
        lines = [x for x in text.split("\n") if x.strip(BLANK_CHARACTERS)]
        rows.append(
            (
                n,
                len(text) - sum(map(text.count, BLANK_CHARACTERS)),
                sum(map(text.count, SYMBOLS)),
                len(lines) - len(set(lines)),
            )
        )
        numbers.append(np.fromiter(map(seen.__getitem__, words), np.int64, n))
        held += n
        if held >= WORDS_AT_ONCE:
            yield from (a + b for a, b in zip(rows, _repetition(numbers, least_repeat)))
            seen, rows, numbers, held = _Numbers(), [], [], 0
    yield from (a + b for a, b in zip(rows, _repetition(numbers, least_repeat)))


def rules(
    text: Column,
    least_repeat: int = LEAST_REPEAT,
    most_covered: float = MOST_COVERED,
    longest_repeat: int = LONGEST_REPEAT,
    least_words: int = LEAST_WORDS,
) -> Column:
    """A struct of measures and verdict per text; see ``RESULT``.

    base_failed: fewer than ``least_words`` words, or over half the words lie in 3-word windows that occur twice.
    kept: not base_failed, repeats of ``least_repeat`` words and more cover at most ``most_covered`` of the words, and
    none is longer than ``longest_repeat`` words. Null and empty texts have no words and fail.
    """

    @F.pandas_udf(RESULT)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lean_memory()
        for series in batches:
            made = list(_measures(series, least_repeat))
            columns = np.array(made, np.int64).reshape(-1, 7).T
            n, chars, symbols, lines, three, cover, longest = columns
            failed = (n < least_words) | (100 * three > 50 * n)
            yield pd.DataFrame(
                {
                    "n_words": n,
                    "word_chars": chars,
                    "n_symbols": symbols,
                    "n_dup_lines": lines,
                    "n_repeat_words": three,
                    "base_failed": failed,
                    "covered_words": cover,
                    "longest_repeat": longest,
                    "kept": ~failed & (cover <= most_covered * n) & (longest <= longest_repeat),
                }
            )

    return measure(text)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id and the fields of ``rules``, one row per row of ``docs``.

    Rows are judged each on its own: repeated rows repeat, a null doc_id is carried, other columns are ignored, an
    empty table gives an empty result.
    """
    judged = docs.select(F.col(id_col).cast("long").alias("doc_id"), rules(whole_text(text_col), **limits).alias("r"))
    return judged.select("doc_id", "r.*")


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.where(rules(whole_text(text_col), **limits)["kept"])
