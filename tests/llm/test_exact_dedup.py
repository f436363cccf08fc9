import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lossgauge.llm import exact_dedup


def expected(rows):
    """Brute force: one entry per distinct (doc_id, normalised text); the size of a group counts rows."""
    docs, sizes = {}, Counter()
    for i, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        sizes[norm] += 1
        docs[i, norm] = max(docs.get((i, norm), 0), len(text or ""))
    out = []
    for (i, norm), chars in docs.items():
        group = [(-c, j is None, j or 0, j) for (j, m), c in docs.items() if m == norm]
        best = min(group)
        out.append((i, best[3], sizes[norm], (-chars, i is None, i or 0, i) == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, *args, **options):
    result = exact_dedup.exact_duplicates(df, *args, **options).drop("chars", "rows")
    return sorted((tuple(r) for r in result.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1, 3, 2048])
def test_groups_equal_brute_force(spark, block_bytes):
    texts = ["abcabc", "abc abc", "ab\tcabc", "abcab", "cababc", "a", "", None, " ", "aa", "aaa", "aaaa", "aaaaa", "ééé", "éé é"]
    rows = list(enumerate(texts * 2)) + [(None, "abcabc"), (3, "abc ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, block_bytes=block_bytes) == expected(rows)


def test_blocks_with_one_hash_keep_their_own_names(spark):
    rows = [(i, t) for i, t in enumerate(["abcdef", "abcdeg", "abc def", "xbcdef", "abcxef", "abcdef!", "ab"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda block: F.octet_length(block).cast("long")
    assert found(df, block_bytes=2, block_hash=weak) == expected(rows)


def test_messy_rows_and_no_rows(spark, messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(messy) == expected(rows)
    assert found(messy.limit(0)) == []


def test_one_row_of_each_group_stays_with_its_columns(messy):
    kept = exact_dedup.keep_first_of_each(messy)
    assert kept.columns == messy.columns
    texts = [re.sub(r"\s", "", r["text"] or "") for r in kept.collect()]
    all_texts = {re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in messy.collect()}
    assert len(texts) == len(set(texts)) == len(all_texts)


def test_query_equals_its_sql_on_repeated_rows(spark, tmp_path):
    import duckdb

    from lossgauge.llm import queries

    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (2, "ab"), (None, "a b"), (None, "a b"), (3, "c"), (3, "c"), (None, "d"), (None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = database.sql(queries.ORACLES["op1_exact_dedup"])
    found = queries.op1_exact_dedup(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want.fetchall(), key=repr)
