import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from lossgauge.llm import queries, simhash


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits):
    """Component of each position by union of all pairs within ``bits``: the smallest position."""
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return [top(x) for x in range(len(prints))]


def test_fingerprint_of_long_and_short_texts():
    for text in ["", None, "  ", "One", "one two three four", "A b C d e", "é " * 700, " ".join(map(str, range(900)))]:
        assert simhash.simhash(text) == fingerprint(text)


def clustered(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(8)]
    out = {rng.getrandbits(64) for _ in range(20)}
    while len(out) < n:
        base = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            base ^= 1 << rng.randrange(64)
        out.add(base)
    return sorted(out)


@pytest.mark.parametrize("bits, hot, chance", [(4, 4096, 64), (4, 8, 64), (3, 8, 64), (4, 4096, 1e-7)])
def test_components_of_links(spark, bits, hot, chance):
    prints = clustered(bits, 260)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df, bits, hot=hot, chance=chance)
    pairs = [(r["a"], r["b"]) for r in edges.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in pairs)
    if hot > 260:
        true = sum((a ^ b).bit_count() <= bits for a, b in itertools.combinations(prints, 2))
        assert len(pairs) == len(set(pairs)) == true
    root = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    got = [root.get(x, x) for x in signed]
    want = groups(prints, bits)
    assert [[g == h for h in got] for g in got] == [[w == v for v in want] for w in want]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in simhash.components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_query_equals_brute_force(spark, small, raw):
    docs = sorted(raw[0].items())
    prints = [fingerprint(t) for _, t in docs]
    roots = groups(prints, 4)
    want = [(i, f"{p:016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, roots)]
    assert sorted(map(tuple, queries.op4_simhash(spark, small).collect())) == want


def test_messy_rows(messy):
    found = simhash.near_duplicates(messy).collect()
    assert len(found) == messy.count()
    empty = {r["component_id"] for r in found if int(r["fingerprint"], 16) == 0}
    assert empty == {3}
    unnamed = [r for r in found if r["doc_id"] is None and int(r["fingerprint"], 16)]
    assert [r["component_id"] for r in unnamed] == [None, None]
    assert simhash.near_duplicates(messy.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(messy)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 8, 9] and ids.count(None) == 1


def test_one_id_on_unrelated_texts(spark):
    lone = " ".join(f"alone{i}" for i in range(80))
    base = " ".join(f"word{i}" for i in range(400))
    near = base + " "
    other = " ".join(f"other{i}" for i in range(80))
    texts = [(5, lone, "A"), (5, near, "B"), (3, base, "B"), (7, lone, "A"), (7, other, "C"), (7, other, "C"), (None, near, "B")]
    for turned in (texts, texts[::-1]):
        docs = spark.createDataFrame(turned, "doc_id long, text string, part string")
        kept = simhash.keep_one_of_each(docs).select("part", "doc_id").collect()
        assert sorted(map(tuple, kept)) == [("A", 5), ("B", 3), ("C", 7)]
    # one id on every row
    docs = spark.createDataFrame([(5, t, p) for _, t, p in texts], "doc_id long, text string, part string")
    assert sorted(r["part"] for r in simhash.keep_one_of_each(docs).collect()) == ["A", "B", "C"]


def test_crowded_keys_with_an_odd_bound(spark):
    # connected over pairs that meet 1 bit from the one and 2 bits from the other
    low = [
        [2, 44, 65, 106, 112, 192, 221, 268, 300, 342, 399, 421, 430, 446, 470],
        [1, 11, 16, 117, 151, 232, 233, 245, 258, 391, 433, 455, 488],
        [107, 110, 127, 152, 195, 294, 344, 374, 383, 412, 414, 422, 469, 486],
    ]
    prints = [(0x0F3A5C + 0x1B2D47 * i) * (1 << 40) + x for i, xs in enumerate(low) for x in xs]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, hot=8)
    assert all(r["a"] < r["b"] and (r["a"] ^ r["b"]).bit_count() <= 3 for r in edges.collect())
    root = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    got, want = [root.get(x, x) for x in signed], groups(prints, 3)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
