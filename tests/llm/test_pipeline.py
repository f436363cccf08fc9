import itertools
import re
import zlib

import numpy as np

import corpus_pipeline
from lossgauge.llm import pii, queries, simhash, tokens
from lossgauge.llm import quality_rules as q


def brute_force(docs, encoder):
    """Plain Python over (doc_id, text): the documents before packing, and their ids."""
    verdicts = list(q._measures([t for _, t in docs], q.LEAST_REPEAT))
    docs = [
        d
        for d, (n, _, _, _, three, cover, longest) in zip(docs, verdicts)
        if n >= 50 and 100 * three <= 50 * n and cover <= q.MOST_COVERED * n and longest <= q.LONGEST_REPEAT
    ]
    best = {}
    for i, t in sorted(docs, key=lambda d: (-len(d[1]), d[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), (i, t))
    docs = sorted(best.values())
    prints = [simhash.simhash(t) for _, t in docs]
    least = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(docs)), 2):
            if least[a] != least[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    docs = [d for k, d in enumerate(docs) if least[k] == k]
    docs = [(i, pii._rewrite(t, queries.MASKING_KEY, {})[0]) for i, t in docs]
    return docs, {i: np.append(encoder.encode(t), 1).astype("<u4") for i, t in docs}


def test_pipeline_equals_brute_force(spark, small, raw, tokenizer_file):
    docs, ids = brute_force(sorted(raw[0].items()), tokens.Encoder(tokenizer_file))
    assert 100 < len(docs) < 200
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {p["doc_id"] for p in pieces} == set(ids)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[p["doc_id"]])) == (p["length"], p["ids_crc32"], p["doc_tokens"])


def test_stages_keep_the_columns_of_messy_documents(spark, messy, tmp_path):
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, None)
        assert made.columns == messy.columns, name
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r["doc_id"] for r in docs.collect()} <= {6, 7}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).columns[:3] == ["doc_id", "start", "length"]


def test_stages_of_no_documents(spark, messy):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy.limit(0), None).count() == 0
