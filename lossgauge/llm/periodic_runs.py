"""Periodic runs of words: maximal stretches that repeat with a period.

The first phase of Baier's suffix sorter groups the suffixes by the longest Lyndon word each starts with; the lengths of
these words are the Lyndon array. It is run under an order of the words and under the reverse order. By the runs theorem
every run has its Lyndon root among these words under one of the two, so each of them is extended to both sides by
longest common extensions, and those that reach the least length and exponent are the runs.

Before that, whole batches of documents are searched for windows of words that occur twice in their document. A run holds
no other windows (see ``window_width``), so the phase runs on stretches of such windows only. That leaves out no run.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgauge.llm.common import lean_memory, whole_text

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
WORDS_AT_ONCE = 150_000
# odd 64-bit multipliers that spread word numbers over a hash
SPREAD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

RUN = "struct<start: long, length: long, period: long>"

Run = tuple[int, int, int]


def lyndon_groups(words: Sequence[int]) -> tuple[list[int], list[int]]:
    """(length, group) of the longest Lyndon word that starts at each position, in linear time.

    ``words`` are numbers from 0 up, without gaps; a smaller number is a smaller word. Positions are in one group
    exactly if their Lyndon words are equal.

    The groups begin as one per word. From the highest down, each group looks from its positions to the nearest
    position before that is in a lower group: the word there goes on through this group's, once per position that looks
    to it. Those positions leave their group for a new one directly above it, more repeats above fewer.
    """
    n, m = len(words), max(words, default=-1) + 1
    group, length = list(words), [1] * m
    members: list[list[int]] = [[] for _ in range(m)]
    for i, word in enumerate(words):
        members[word].append(i)
    below, above = list(range(-1, m - 1)), [*range(1, m), -1]
    # positions of groups that are still to come, as a linked list; the last two places stand for its ends
    before, after = [*range(-1, n + 1)], [*range(1, n + 3)]
    current = m - 1
    while current >= 0:
        width, moves = length[current], {}
        last, repeats = -1, 0
        for i in members[current]:
            if group[i] != current:
                continue
            j, k = before[i], after[i]
            after[j], before[k] = k, j
            if j == last:
                repeats += 1
                continue
            if last >= 0:
                moves.setdefault((repeats, group[last]), []).append(last)
            last, repeats = j, 1
        if last >= 0:
            moves.setdefault((repeats, group[last]), []).append(last)
        for repeats, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            moved, new, higher = moves[repeats, old], len(length), above[old]
            for i in moved:
                group[i] = new
            members.append(moved)
            length.append(length[old] + repeats * width)
            below.append(old)
            above.append(higher)
            above[old] = new
            if higher >= 0:
                below[higher] = new
        members[current] = []
        current = below[current]
    return [length[g] for g in group], group


def _gallop(matches: Callable[[int, int], bool], room: int) -> int:
    """The length of the match: ``matches(done, step)`` says if it goes on for ``step`` more than ``done``. Steps double
    up to the first that fails, then shrink."""
    done, step, growing = 0, 1, True
    while done < room:
        step = min(step, room - done)
        if matches(done, step):
            done += step
            step = step * 2 if growing else step
        elif step == 1:
            break
        else:
            growing, step = False, step // 2
    return done


def _common_after(data: bytes, i: int, j: int, n: int) -> int:
    """How many words from ``i`` on equal those from ``j`` on, i < j."""
    a, b = 4 * i, 4 * j
    return _gallop(lambda d, s: data[a + 4 * d : a + 4 * (d + s)] == data[b + 4 * d : b + 4 * (d + s)], n - j)


def _common_before(data: bytes, i: int, j: int) -> int:
    """How many words before ``i`` equal those before ``j``, i < j."""
    a, b = 4 * i, 4 * j
    return _gallop(lambda d, s: data[a - 4 * (d + s) : a - 4 * d] == data[b - 4 * (d + s) : b - 4 * d], i)


def find_runs(words: Sequence[int], least_length: int = LEAST_LENGTH, least_exponent: float = LEAST_EXPONENT) -> list[Run]:
    """(start, length, period) of every run of at least ``least_length`` words and ``least_exponent`` periods, in order.

    ``least_exponent`` is 2 or more. ``words`` are numbers; equal numbers are equal words.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    n = len(words)
    dense: dict[int, int] = {}
    ranks = [dense.setdefault(w, len(dense)) for w in words]
    data = np.array(ranks, "<u4").tobytes()
    found = set()
    for order in (ranks, [len(dense) - 1 - r for r in ranks]):
        length, group = lyndon_groups(order)
        reach: dict[int, int] = {}
        for i, period in enumerate(length):
            j = i + period
            # of three periods, two roots in a row are whole
            if j >= n or least_exponent >= 3 and group[i] != group[j] or j <= reach.get(period, -1):
                continue
            end = j + _common_after(data, i, j, n)
            start = i - _common_before(data, i, j)
            if end - start >= 2 * period:
                reach[period] = end
                if end - start >= max(least_length, least_exponent * period):
                    found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def window_width(least_length: int, least_exponent: float) -> int:
    """The greatest width w for which every window of w words inside a run occurs twice in that run.

    A run of length L and period q has L - w + 1 windows, and each has its like q words on or back if these are 2q or
    more. That is tightest at the greatest q for which ``least_length`` rules, or at the next one.
    """
    q = math.floor(least_length / least_exponent)
    return min(least_length - 2 * q, math.ceil(least_exponent * (q + 1)) - 2 * (q + 1)) + 1


def _stretches(words: np.ndarray, document: np.ndarray, least_length: int, least_exponent: float) -> list[tuple[int, int]]:
    """Bounds of the stretches that consist of windows which occur twice in their document, long enough for a run.

    Windows are counted by hash: one that occurs once may count as frequent, never the other way round.
    """
    width = window_width(least_length, least_exponent)
    if len(words) < least_length:
        return []
    mixed = words.astype(np.uint64) * SPREAD
    mixed ^= mixed >> np.uint64(29)
    mixed *= STEP
    code = mixed
    for ahead in range(1, width):
        code = code[:-1] * SPREAD + mixed[ahead:]
    inside = document[: len(code)] == document[width - 1 :]
    bits = (8 * len(words)).bit_length()
    code = ((code ^ document[: len(code)].astype(np.uint64) * STEP) * SPREAD) >> np.uint64(64 - bits)
    code = code.astype(np.int64)
    often = inside & (np.bincount(code[inside], minlength=1 << bits)[code] > 1)
    label = np.where(often, document[: len(code)] + 1, 0)
    edges = np.flatnonzero(np.diff(label, prepend=0, append=0))
    starts, ends = edges[:-1], edges[1:]
    starts, ends = starts[label[starts] > 0], ends[label[starts] > 0] + width - 1
    long = ends - starts >= least_length
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def _runs_of_each(documents: list[list[bytes]], least_length: int, least_exponent: float) -> list[list[Run]]:
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(words) for words in documents], np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for d in documents for w in d), np.int64, int(lengths.sum()))
    document, first = np.repeat(np.arange(len(documents)), lengths), np.cumsum(lengths) - lengths
    out: list[list[Run]] = [[] for _ in documents]
    for a, b in _stretches(words, document, least_length, least_exponent):
        owner = int(document[a])
        shift = a - int(first[owner])
        runs = find_runs(words[a:b].tolist(), least_length, least_exponent)
        out[owner].extend((start + shift, length, period) for start, length, period in runs)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run of the greatest exponent; then the first, then the one of the shortest period."""
    return min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_exponent: float = LEAST_EXPONENT,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed): the periodic runs of every text, and the text without repeats.

    ``runs`` lists start (word number from 0), length and period in words by start and period; ``strongest`` is the run
    of the greatest exponent, null where there is none; ``collapsed`` joins by one space the words that no run holds
    after its first period. ``prepare(doc_id, words)`` may return other words in place of a document's own.

    Rows are judged each on its own: repeated rows repeat, a null doc_id is carried, null and empty texts have no words,
    no run and an empty ``collapsed``; other columns are ignored, an empty table gives an empty result.
    """

    def chunk(ids, documents) -> pa.RecordBatch:
        each = _runs_of_each(documents, least_length, least_exponent)
        flat = np.array([r for runs in each for r in runs], np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(runs) for runs in each])]).astype(np.int32)
        fields = ["start", "length", "period"]
        best = [dict(zip(fields, r)) if (r := strongest(runs)) else None for runs in each]
        run_type = pa.struct([(f, pa.int64()) for f in fields])
        listed = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(d) for d in documents], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), listed),
                pa.array(best, run_type),
                pa.array([b" ".join(collapse(d, runs)).decode() for d, runs in zip(documents, each)], pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            ids, documents, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                # of bytes: splits at the six blanks only
                words = text.as_py().encode().split()
                ids.append(doc_id.as_py())
                documents.append(prepare(ids[-1], words) if prepare else words)
                held += len(words)
                if held >= WORDS_AT_ONCE:
                    yield chunk(ids, documents)
                    ids, documents, held = [], [], 0
            if ids:
                yield chunk(ids, documents)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(find, f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")
