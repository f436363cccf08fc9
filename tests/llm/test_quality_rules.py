import random
import re

import numpy as np

from lossgauge.llm import quality_rules as q


def brute(words):
    """For each position the longest substring there that occurs elsewhere."""
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_longest_repeats_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        docs = [[rng.randrange(rng.choice((1, 2, 5))) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        lengths = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), lengths)
        words = np.array([w for d in docs for w in d], np.int64) + owner * (1 << 32)
        found = q.longest_repeats(words, np.cumsum(lengths)[owner])
        assert found.tolist() == [x for d in docs for x in brute(d)]


def test_a_single_word_repeated_very_often():
    n = 20_000
    found = q.longest_repeats(np.zeros(n, np.int64), np.full(n, n))
    assert found[0] == n - 1 and found[-1] == 1


def expected(text, least, most, longest):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    repeat = brute(words)
    cover = {i + k for i, r in enumerate(repeat) if r >= least for k in range(r)}
    three = {i + k for i, r in enumerate(repeat) if r >= 3 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(three) > 50 * len(words)
    good = len(cover) <= most * len(words) and max(repeat, default=0) <= longest
    measures = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)))
    return (*measures, len(three), failed, len(cover), max(repeat, default=0), not failed and good)


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(8)
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n", base, base + "\n" + base, base + " x " + " ".join(f"w{i}" for i in range(20)), "# a|b <c>\n" * 9]
    texts += [base + " " + " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"v{i}" for i in range(120))]
    texts += [" ".join(rng.choice(("a", "b", "c\n", "d e")) for _ in range(90)) for _ in range(10)]
    texts += [" ".join(f"{rng.randrange(40)}" for _ in range(120)) + "\x0b\x0c\x1c\x85\xa0é" for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = q.quality_rules(df, least_repeat=6, most_covered=0.25, longest_repeat=25).collect()
    want = [(i, *expected(t, 6, 0.25, 25)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, found)) == want


def test_batches_do_not_matter(monkeypatch):
    texts = ["a b c a b c " * 4, "x y", "", None, "a b c d"]
    whole = list(q._measures(texts, 3))
    monkeypatch.setattr(q, "WORDS_AT_ONCE", 1)
    assert list(q._measures(texts, 3)) == whole


def test_messy_rows(messy):
    found = q.quality_rules(messy)
    assert found.count() == messy.count() and q.quality_rules(messy.limit(0)).count() == 0
    kept = q.keep_good(messy)
    assert kept.columns == messy.columns and {r["doc_id"] for r in kept.collect()} <= {6, 7}
