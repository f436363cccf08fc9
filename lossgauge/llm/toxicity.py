"""Toxicity by a weighted lexicon.

Text is folded first: lower case, look-alike letters and digits to the letters they stand for. The lexicon is matched
by Aho-Corasick on the folded text; entries are whole words or beginnings of words, and a match inside an exception
phrase does not count. The summed weights, and their sum per length of text, give a score between 0 and 1.

The lexicon is learned from a bounded sample of labelled documents: an entry needs evidence on all toxic documents of
the sample, and its weight is how far its counts lean to them. Exception phrases are learned too: two words, one of them
matched by an entry, that stand in clean documents of the sample and in hardly any toxic one. Near copies count once, so
that the private words of a document with many copies don't enter. A fixed list serves only where labels teach no entry.
Nothing of a document but its text is ever an input of its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgauge.llm import simhash
from lossgauge.llm.common import held_out, labelled_sample, whole_text

SAMPLE = 8_000
LEAST_EVIDENCE = 25.0
# an exception phrase stands in so many clean documents, and in so many times fewer toxic ones
LEAST_CLEAN, CLEAN_LEAN = 3, 10
PREFIXES = range(4, 9)
STRENGTH = 0.3
# of the score where labels teach no entry: a single seed in any text reaches 0.5
DEFAULT_MODEL = (-3.0, 2.0, 0.0)

# Letters and digits that stand for another letter, and that letter. l and i share one form, as 1 may
# stand for either.
LOOKALIKES = (
    # digits and signs
    ("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"), ("9", "g"),
    ("@", "a"), ("$", "s"), ("l", "i"),
    # Greek
    ("α", "a"), ("β", "b"), ("ε", "e"), ("η", "n"), ("ι", "i"), ("κ", "k"), ("ν", "v"), ("ο", "o"), ("ρ", "p"),
    ("σ", "o"), ("τ", "t"), ("υ", "u"), ("χ", "x"), ("ω", "w"),
    # Cyrillic
    ("а", "a"), ("в", "b"), ("г", "r"), ("е", "e"), ("з", "e"), ("и", "u"), ("к", "k"), ("м", "m"), ("н", "h"),
    ("о", "o"), ("п", "n"), ("р", "p"), ("с", "c"), ("т", "t"), ("у", "y"), ("х", "x"), ("ь", "b"), ("ѕ", "s"),
    ("і", "i"), ("ј", "j"), ("ԁ", "d"), ("ԛ", "q"), ("ԝ", "w"), ("һ", "h"), ("ӏ", "i"),
    # Latin variants
    ("ı", "i"), ("ɑ", "a"), ("ɡ", "g"), ("ʟ", "i"), ("ɩ", "i"), ("ո", "n"), ("օ", "o"), ("ս", "u"),
)

# Words of abuse, for where labels teach no entry
SEEDS = (
    # English
    "idiot", "idiots", "stupid", "moron", "morons", "scum", "trash", "loser", "losers", "worthless", "pathetic",
    "disgusting", "clown", "dumb", "jerk", "imbecile", "filth", "vermin", "freak", "dimwit", "scumbag", "bastard",
    "asshole", "bitch", "retard", "fuck", "fucking", "shit",
    # German
    "idioten", "dumm", "trottel", "abschaum", "arschloch", "vollidiot", "widerlich", "wertlos", "dreckig",
    # French
    "crétin", "débile", "connard", "ordure", "abruti", "minable", "imbécile", "dégoûtant",
    # Spanish
    "idiota", "estúpido", "imbécil", "basura", "escoria", "asqueroso", "patético", "payaso",
)
SEED_WEIGHT = 4.0

def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(a): b for a, b in LOOKALIKES}
    folded = dict(LOOKALIKES)
    # full-width letters and digits follow the plain ones at a fixed distance
    for plain in "abcdefghijklmnopqrstuvwxyz0123456789":
        table[ord(plain) + 0xFEE0] = folded.get(plain, plain)
    # characters without width
    table.update(dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
    return table


_FOLDING = _folding()
_FOLDED_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLDING)


@dataclass(frozen=True)
class Lexicon:
    """Folded entries with weights. ``*`` at the end of an entry stands for any rest of the word."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    # of the score: constant, factor of the logarithm of the summed weight, and of the sum per 1000 characters
    model: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def matcher(self):
        """The summed weight of a folded text, as a function."""
        import ahocorasick

        found = ahocorasick.Automaton()
        kinds: dict[str, list] = {}
        for entry, weight in self.entries:
            kinds.setdefault(entry.rstrip("*"), []).append((entry.endswith("*"), weight))
        for phrase in self.exceptions:
            kinds.setdefault(fold(phrase), []).append((False, None))
        for form, meanings in kinds.items():
            found.add_word(form, (len(form), meanings))
        if not kinds:
            return lambda text: 0.0
        found.make_automaton()

        def weigh(text: str) -> float:
            best: dict[int, tuple[int, float]] = {}
            excused: list[tuple[int, int]] = []
            for end, (length, meanings) in found.iter(text):
                start, after = end - length + 1, end + 1
                if start and text[start - 1].isalnum():
                    continue
                whole = after == len(text) or not text[after].isalnum()
                for is_prefix, weight in meanings:
                    if weight is None:
                        if whole:
                            excused.append((start, after))
                    elif (whole or is_prefix) and weight > best.get(start, (0, 0.0))[1]:
                        best[start] = (after, weight)
            if excused:
                inside = lambda a, b: any(x <= a and b <= y for x, y in excused)
                return sum(w for start, (after, w) in best.items() if not inside(start, after))
            return sum(w for _, w in best.values())

        return weigh

    def features(self, texts, weigh=None) -> np.ndarray:
        weigh = weigh or self.matcher()
        rows = []
        for text in texts:
            folded = fold(text or "")
            weight = weigh(folded)
            rows.append((np.log1p(weight), np.log1p(1000 * weight / max(100, len(folded)))))
        return np.array(rows, float).reshape(-1, 2)

    def score(self, texts, weigh=None) -> np.ndarray:
        """The score of each text; ``weigh`` is a matcher made before."""
        constant, total, density = self.model
        x = self.features(texts, weigh)
        return 1 / (1 + np.exp(-(constant + total * x[:, 0] + density * x[:, 1])))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of at most ``size`` labelled documents outside the held-out fold, least id hashes first.

    A document with several labels has the largest; null labels and ids are left out. An id with several texts is one
    document, with the text of the least hash.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return labelled_sample(texts, marks, size)


def _entries_of(text: str) -> set[str]:
    found = set()
    for word in set(_FOLDED_WORD.findall(fold(text))):
        found.add(word)
        found.update(word[:n] + "*" for n in PREFIXES if n <= len(word))
    return found


def _evidence(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Twice the log-likelihood ratio of an entry's counts; negative where it speaks for clean documents."""
    n = float(toxic + clean)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    with_it, without = t + c, F.lit(n) - t - c
    total = part(t, with_it * toxic / n) + part(c, with_it * clean / n)
    total += part(toxic - t, without * toxic / n) + part(clean - c, without * clean / n)
    return F.when(t * clean >= c * toxic, 2 * total).otherwise(-2 * total)


def _choose(counts: DataFrame, toxic: int, clean: int, least: float) -> list[tuple[str, float]]:
    """All entries with evidence on the documents, weighed by the logarithm of their odds."""
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    odds = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((c + 0.5) / (clean - c + 0.5))
    strong = counts.where("t >= 3").where(_evidence(t, c, toxic, clean) >= least)
    chosen = strong.select("entry", F.greatest(odds, F.lit(0.1)).alias("weight")).collect()
    return sorted((r["entry"], r["weight"]) for r in chosen)


def _phrases_of(text: str, whole: set[str], heads: set[str]) -> set[str]:
    """Pairs of neighbouring words one of which an entry matches."""
    words = list(_FOLDED_WORD.finditer(text := fold(text)))
    hit = [w.group() in whole or any(w.group()[:n] in heads for n in PREFIXES) for w in words]
    return {
        text[a.start() : b.end()]
        for a, b, x, y in zip(words, words[1:], hit, hit[1:])
        if (x or y) and b.start() - a.end() == 1
    }


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``group``: near copies have the same."""
    printed = rows.withColumn("fp", simhash.fingerprint(F.col("text")))
    linked = simhash.components(simhash.links(printed.select("fp").distinct())).withColumnRenamed("node", "fp")
    return printed.join(linked, "fp", "left").withColumn("group", F.coalesce("component", "fp")).drop("fp", "component")


def _logistic(x: np.ndarray, y: np.ndarray, strength: float) -> tuple[float, ...]:
    """Newton steps for a logistic regression with a squared penalty on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.array([1e-3] + [strength] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _seen(rows: DataFrame, found_in, name: str) -> DataFrame:
    """(name, t, c): how many toxic and clean groups of near copies hold each of the texts that ``found_in`` finds."""

    def look(batches):
        for batch in batches:
            for group, text, mark in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = list(found_in(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([group] * len(found), pa.int64()),
                     pa.array([mark] * len(found), pa.int32())],
                    [name, "group", "label"],
                )

    seen = rows.select("group", "text", "label").mapInArrow(look, f"{name} string, group long, label int")
    seen = seen.select(name, "group", (F.col("label") == 1).alias("toxic")).distinct()
    return seen.groupBy(name).agg(
        F.sum(F.col("toxic").cast("long")).alias("t"), F.sum((~F.col("toxic")).cast("long")).alias("c")
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    sample: int = SAMPLE,
    least_evidence: float = LEAST_EVIDENCE,
    exceptions: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Lexicon:
    """Learn entries, weights, exceptions and score from at most ``sample`` labelled documents outside the held-out fold.

    What reaches the driver is bounded by the sample: the entries with evidence, exceptions beside them, and two numbers
    per document. ``exceptions`` are phrases to excuse in any case. Where labels teach no entry the lexicon is the fixed
    list, with a fixed model.
    """
    from lossgauge.session import stable

    fixed = Lexicon(tuple((s, SEED_WEIGHT) for s in dict.fromkeys(map(fold, SEEDS))), tuple(exceptions), DEFAULT_MODEL)
    rows = stable(training_sample(docs, labels, label, sample, id_col, text_col))
    is_toxic = F.col("label") == 1
    if {r["toxic"] for r in rows.select(is_toxic.alias("toxic")).distinct().collect()} != {True, False}:
        return fixed
    rows = stable(_grouped(rows))
    # near copies count once, with each label that they have
    of_toxic, of_clean = F.when(is_toxic, F.col("group")), F.when(~is_toxic, F.col("group"))
    toxic, clean = rows.agg(F.count_distinct(of_toxic), F.count_distinct(of_clean)).first()
    chosen = _choose(_seen(rows, _entries_of, "entry"), toxic, clean, least_evidence)
    if not chosen:
        return fixed
    whole = {e for e, _ in chosen if not e.endswith("*")}
    heads = {e[:-1] for e, _ in chosen if e.endswith("*")}
    # shares, as there may be far more clean documents than toxic ones
    lean = F.col("c") / F.lit(clean) >= CLEAN_LEAN * F.col("t") / F.lit(toxic)
    harmless = _seen(rows, lambda text: _phrases_of(text, whole, heads), "phrase").where(F.col("c") >= LEAST_CLEAN).where(lean)
    excused = sorted(r["phrase"] for r in harmless.select("phrase").collect())
    found = Lexicon(tuple(chosen), (*exceptions, *excused))

    def features(batches: Iterator[pd.DataFrame]):
        weigh = found.matcher()
        for batch in batches:
            x = found.features(batch.text, weigh)
            yield pd.DataFrame({"total": x[:, 0], "density": x[:, 1], "label": (batch.label == 1).astype(int)})

    x = rows.select("text", "label").mapInPandas(features, "total double, density double, label int").toPandas()
    x = x.sort_values(["total", "density", "label"])
    model = _logistic(x[["total", "density"]].to_numpy(float), x.label.to_numpy(float), STRENGTH)
    return Lexicon(found.entries, found.exceptions, model)


def score(text: Column, lexicon: Lexicon) -> Column:
    """Score of each text between 0 and 1. Null and empty texts match nothing."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weigh = lexicon.matcher()
        for texts in batches:
            yield pd.Series(lexicon.score(texts, weigh))

    return scores(text)


def classify(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on), one row per row.

    Null text counts as empty; a null doc_id is carried and counts as the text '' for the fold. Repeated rows repeat,
    other columns are ignored, an empty table gives an empty result.
    """
    scored = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), score(whole_text(text_col), lexicon).alias("score")
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
