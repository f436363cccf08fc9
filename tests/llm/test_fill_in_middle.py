import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossgauge.llm import fill_in_middle as fim

PIECES = ["a", "Z", "z", "A", "[", "`", "{", "@", "é", " ", "\n", "😀", "ab", "K", "<P", "<", ">", "S>"]


def some_texts(n=200):
    rng = random.Random(4)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def bounds_of(text):
    found = [0]
    for token in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
        found.append(found[-1] + len(token))
    return found


def test_bounds_and_selection_equal_the_pattern():
    for text in some_texts():
        wanted = bounds_of(text)
        assert fim.token_bounds(text).tolist() == wanted
        held = fim.BoundarySet(fim.token_bounds(text))
        assert [held.select(k) for k in range(held.size)] == wanted


@pytest.mark.parametrize("share, kind", [(0.001, "Array"), (0.4, "Bitmap"), (0.999, "Run"), (1.0, "Run")])
def test_every_kind_of_container_selects(share, kind):
    offsets = np.flatnonzero(np.random.default_rng(3).random(4 * 65_536) < share)
    held = fim.BoundarySet(offsets)
    assert len(held.containers) == 4 and {type(c).__name__ for c in held.containers} == {f"{kind}Container"}
    step = max(1, len(offsets) // 3000)
    for k in [*range(0, len(offsets), step), len(offsets) - 1]:
        assert held.select(k) == offsets[k]
    with pytest.raises(IndexError):
        held.select(len(offsets))


def test_gaps_between_containers():
    offsets = np.array([0, 5, 65_535, 65_536, 400_000, 400_001])
    assert [fim.BoundarySet(offsets).select(k) for k in range(6)] == offsets.tolist()


def expected(doc_id, text, percent=90, suffix_first=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    bounds = bounds_of(text)
    a, b = sorted((bounds[h1 % len(bounds)], bounds[h2 % len(bounds)]))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= percent:
        return doc_id, len(bounds) - 1, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return doc_id, len(bounds) - 1, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(bounds) - 1, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_output_equals_brute_force_and_goes_back(spark):
    texts = [None, "", "\n", "one<M>two", *some_texts(400)]
    rows = list(enumerate(texts)) + [(None, "no id here"), (7, "again 7"), (7, "again 7")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = fim.fill_in_middle(df, percent=80, suffix_first_percent=50)
    made = sorted(map(tuple, found.collect()), key=repr)
    assert made == sorted((expected(i, t, 80, 50) for i, t in rows), key=repr)
    assert {r[2] for r in made} == {"plain", "psm", "spm"}
    back = found.select("doc_id", fim.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_messy_rows(messy):
    found = fim.fill_in_middle(messy)
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert fim.fill_in_middle(messy.limit(0)).count() == 0
