import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from lossgauge.llm import periodic_runs as pr
from lossgauge.llm import queries


def lyndon_lengths(words):
    """The longest Lyndon prefix of a suffix ends where the next smaller suffix begins."""
    n = len(words)
    return [next((j for j in range(i + 1, n) if words[j:] < words[i:]), n) - i for i in range(n)]


def brute_runs(words, least_length, least_exponent):
    """Every stretch of equal words p apart that goes no further, unless a smaller period does for it as well."""
    out, n = [], len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            part = words[start : i + p]
            if len(part) >= max(least_length, least_exponent * p, 2 * p):
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((start, len(part), p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    kinds, n = rng.choice((1, 2, 3, 6)), rng.randint(0, 45)
    words = [rng.randrange(kinds) for _ in range(n)]
    if rng.random() < 0.4 and n:
        words += words[-rng.randint(1, 6) :] * rng.randint(1, 5)
    return words


def test_lyndon_words_and_their_groups_under_both_orders():
    rng = random.Random(5)
    for _ in range(600):
        words = some_words(rng)
        dense = {w: i for i, w in enumerate(sorted(set(words)))}
        ranks = [dense[w] for w in words]
        for order in (ranks, [len(dense) - 1 - r for r in ranks]):
            length, group = pr.lyndon_groups(order)
            assert length == lyndon_lengths(order)
            roots = [tuple(order[i : i + x]) for i, x in enumerate(length)]
            assert len(set(zip(roots, group))) == len(set(roots)) == len(set(group))


@pytest.mark.parametrize("least_length, least_exponent", [(1, 2), (6, 2.5), (4, 3), (9, 3.5), (24, 3)])
def test_runs_equal_brute_force(least_length, least_exponent):
    rng = random.Random(least_length)
    for _ in range(300):
        documents = [some_words(rng) for _ in range(3)]
        wanted = [brute_runs(d, least_length, least_exponent) for d in documents]
        assert [pr.find_runs(d, least_length, least_exponent) for d in documents] == wanted
        # all at once, behind the search for windows that occur twice
        assert pr._runs_of_each([[b"%d" % w for w in d] for d in documents], least_length, least_exponent) == wanted


def test_long_repetitive_words_take_linear_time():
    n = 60_000
    assert pr.find_runs([7] * n) == [(0, n, 1)]
    assert pr.find_runs([i % 977 for i in range(n)]) == [(0, n, 977)]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    assert all(length >= 3 * period for _, length, period in pr.find_runs(b))


def test_a_run_has_two_periods():
    with pytest.raises(ValueError):
        pr.find_runs([1, 1], 1, 1.5)


def test_strongest_and_collapsed():
    assert pr.strongest([(0, 24, 8), (30, 30, 10), (70, 48, 16)]) == (0, 24, 8)
    assert pr.strongest([(0, 24, 8), (30, 31, 10)]) == (30, 31, 10) and pr.strongest([]) is None
    assert pr.collapse([b"a", b"b", b"a", b"b", b"a", b"c"], [(0, 5, 2)]) == [b"a", b"b", b"c"]


def expected(doc_id, text):
    """The columns of the query, from its contract."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 24, 3)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_query_equals_brute_force_on_the_smallest_documents(spark, small, raw):
    short = {i: t for i, t in raw[0].items() if len(t or "") < 6000}
    found = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, small).collect()}
    assert set(found) == set(raw[0])
    wanted = {i: expected(i, t) for i, t in short.items()}
    assert {i: found[i] for i in short} == wanted
    assert sum(r[1] > 0 for r in wanted.values()) > 5


def test_messy_rows(messy):
    found = pr.periodic_runs(messy).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0) for r in messy.collect()
    )
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[4]["collapsed"] == by_id[5]["collapsed"] == "" and by_id[4]["n_words"] == 0 and by_id[4]["strongest"] is None
    assert [tuple(r) for r in by_id[1]["runs"]] == [(0, 27, 9)]
    assert by_id[2]["collapsed"] == "the quick brown fox jumps over the lazy dog"
    # its period of 25,402 words goes in twice, not three times
    assert by_id[6]["n_words"] == 60_000 and by_id[6]["runs"] == []
    assert pr.periodic_runs(messy.limit(0)).count() == 0


def test_small_batches_change_nothing(spark, monkeypatch):
    texts = ["a b " * 20, "", "x " * 30 + "y " * 30, "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(str, pr.periodic_runs(df).collect()))
    monkeypatch.setattr(pr, "WORDS_AT_ONCE", 1)
    assert sorted(map(str, pr.periodic_runs(df).collect())) == whole
