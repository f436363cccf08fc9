"""Quality classifier: ordinal regression with cumulative links on hashed text.

Each document has one linear score from hashed features of its words, shared by all grades; ordered thresholds cut the
score into grades: P(grade >= k) = logistic(score - threshold k). That gives an expected grade, and the probability
of reaching a grade, by which documents are selected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossgauge.llm.common import held_out, labelled_sample, whole_text
from lossgauge.session import stable

BUCKETS = 1 << 17
SAMPLE = 8_000
# buckets of all sampled documents together: some 12 bytes each on the driver
SAMPLE_BUCKETS = 40_000_000
STEPS = 150
RATE = 0.05
STRENGTH = 2e-4

_LETTER_RUNS = re.compile(r"[^\W\d_]+")


def _features_of(word: str) -> tuple[int, int]:
    """Buckets of a word's letters, and of its shape: runs of letters by case, of digits, and its other characters."""
    letters = "".join(_LETTER_RUNS.findall(word)).lower()
    shape, last = [], ""
    for c in word:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            shape.append(kind)
            last = kind
    made = f"w {letters}", "s " + "".join(shape)
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in made)


_REPEATED, _LENGTH = (zlib.crc32(x) % BUCKETS for x in (b"same word again", b"length"))


class _Buckets(dict):
    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        self[word] = _features_of(word)
        return self[word]


def vectorise(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text: logarithms of counts over the root of their length as a vector, so that one telling
    word still counts in a long text. No words give no features."""
    buckets = _Buckets()
    for text in texts:
        words = (text or "").split()
        pairs = np.array(list(map(buckets.__getitem__, words)), np.int64).reshape(-1)
        again = sum(map(str.__eq__, words[1:], words)) if words else 0
        found, counts = np.unique(pairs, return_counts=True)
        values = np.log1p(counts)
        if words:
            found = np.append(found, (_REPEATED, _LENGTH))
            values = np.append(values, (np.log1p(again), np.log1p(len(words))))
        root = (values**2).sum() ** 0.25
        yield found, values / root if root else values


@dataclass(frozen=True)
class Ordinal:
    """Shared weights by bucket, and ascending thresholds; threshold k - 1 stands between grades k - 1 and k."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each text."""
        scores = np.array([self.weights[b] @ v for b, v in vectorise(texts)], float).reshape(-1, 1)
        return 1 / (1 + np.exp(-np.clip(scores - self.thresholds, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, steps: int = STEPS) -> Ordinal:
    """Maximise the likelihood of the grades by full-batch steps with adapted rates, from a fixed start.

    Without rows the weights are zero, and so are the first thresholds.
    """
    weights = np.zeros(BUCKETS)
    cuts = n_grades - 1
    # thresholds: the first one, then logarithms of the gaps
    shape = np.concatenate([[0.0], np.zeros(cuts - 1)])
    if rows:
        index = np.concatenate([b for b, _ in rows])
        value = np.concatenate([v for _, v in rows])
        owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
        above = (grades[:, None] >= np.arange(1, n_grades)).astype(float)
        share = np.clip(above.mean(0), 0.005, 0.995)
        start = np.maximum.accumulate(np.log((1 - share) / share) + 1e-2 * np.arange(cuts))
        shape = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        params = np.concatenate([weights, shape])
        first, second = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            weights, shape = params[:BUCKETS], params[BUCKETS:]
            gaps = np.exp(shape[1:])
            thresholds = shape[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            scores = np.bincount(owner, weights[index] * value, len(rows))
            d_score, d_threshold = _slopes(scores, thresholds, grades)
            d_shape = np.concatenate([[d_threshold.sum()], np.cumsum(d_threshold[::-1])[::-1][1:] * gaps])
            d_weights = np.bincount(index, value * d_score[owner], BUCKETS) + STRENGTH * weights
            gradient = np.concatenate([d_weights, d_shape])
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            params = params - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, shape = params[:BUCKETS], params[BUCKETS:]
    thresholds = shape[0] + np.concatenate([[0.0], np.cumsum(np.exp(shape[1:]))])
    return Ordinal(weights, thresholds)


def _slopes(scores: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the mean negative log-likelihood, by score of each row and by threshold."""
    n, rows = len(scores), np.arange(len(scores))
    tails = 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds, -30, 30)))
    edges = np.column_stack([np.ones(n), tails, np.zeros(n)])
    chance = np.maximum(edges[rows, grades] - edges[rows, grades + 1], 1e-9)
    curve = edges * (1 - edges)
    d_score = -(curve[rows, grades] - curve[rows, grades + 1]) / chance / n
    d_threshold = np.zeros(len(thresholds))
    for k in range(len(thresholds)):
        lower, upper = grades == k + 1, grades == k
        d_threshold[k] = (curve[lower, k + 1] / chance[lower]).sum() - (curve[upper, k + 1] / chance[upper]).sum()
    return d_score, d_threshold / n


def learn(
    docs: DataFrame,
    ratings: DataFrame,
    n_grades: int,
    sample: int = SAMPLE,
    sample_buckets: int = SAMPLE_BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Ordinal:
    """Fit on at most ``sample`` rated documents outside the held-out fold, least id hashes first, as long as they have at
    most ``sample_buckets`` features together.

    ``ratings`` has doc_id and grade, from 0 to ``n_grades`` - 1; a document with several has the greatest, an id with
    several texts is one document. Null ids, null grades and grades out of range are left out. What reaches the driver is
    the hashed features of the sample.
    """
    marks = ratings.select(F.col("doc_id").cast("long").alias("id"), F.col("grade").cast("int").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    chosen = labelled_sample(texts, marks.where(f"label BETWEEN 0 AND {n_grades - 1}"), sample)

    def features(batches):
        for batch in batches:
            for doc_id, text, grade in zip(*(batch.column(i) for i in range(3))):
                found, values = next(vectorise([text.as_py()]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()], pa.int64()),
                        pa.array([grade.as_py()], pa.int32()),
                        pa.array([len(found)], pa.int64()),
                        pa.array([found.astype("<i4").tobytes()], pa.binary()),
                        pa.array([values.astype("<f4").tobytes()], pa.binary()),
                    ],
                    ["id", "grade", "n", "buckets", "values"],
                )

    schema = "id long, grade int, n long, buckets binary, values binary"
    made = stable(chosen.select("id", "text", "label").mapInArrow(features, schema))
    # at most ``sample`` narrow rows
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fitting = made.select("id", so_far.alias("so_far")).where(F.col("so_far") <= sample_buckets).select("id")
    found = made.join(fitting, "id", "left_semi").collect()
    found.sort(key=lambda r: r["id"])
    rows = [(np.frombuffer(r["buckets"], "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float)) for r in found]
    return fit(rows, np.array([r["grade"] for r in found], np.int64), n_grades)


def predict(text: Column, model: Ordinal) -> Column:
    """Array of P(grade >= k) for k = 1, 2, ..."""

    @F.pandas_udf("array<double>")
    def tails(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(model.tails(texts)), dtype=object)

    return tails(text)


def select(
    docs: DataFrame, model: Ordinal, grade: int, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of ``grade`` or better), kept (at least ``least``).

    One row per row. Null text counts as empty and is graded like a text without words, by the thresholds alone; a
    null doc_id is carried. Repeated rows repeat, other columns are ignored, no rows give no rows.
    """
    graded = docs.select(F.col(id_col).cast("long").alias("doc_id"), predict(whole_text(text_col), model).alias("t"))
    tail = F.col("t")[grade - 1]
    return graded.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.aggregate("t", F.lit(0.0), lambda a, x: a + x).alias("expected_grade"),
        tail.alias("tail_probability"),
        (tail >= least).alias("kept"),
    )
