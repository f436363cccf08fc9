import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lossgauge.llm import line_dedup as ld
from lossgauge.session import intermediate_tables
from lossgauge.sources.delimited import read_table

BLANKS = " \t\n\v\f\r"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANKS).translate(SMALL)


def expected(rows, least_documents, least_chars=1):
    documents = Counter()
    for _, text in rows:
        documents.update({key(line) for line in (text or "").split("\n")})
    common = {k for k, n in documents.items() if n >= least_documents and len(k) >= least_chars}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in common]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def some_rows(n=120):
    rng = random.Random(9)
    pool = ["", " ", "A line", "a LINE ", "\ta line\r", "É", "é", "KK", "kk", "İ", "x\x0b", "x", " x", " ", "long " * 40]
    pool += [f"rare {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(n)]
    return [*rows, (None, "a line\nonly here"), (None, None), (5, "a line\na line"), (5, "a line\na line")]


@pytest.mark.parametrize("batches, fan, least_documents, least_chars", [(1, 2, 3, 1), (5, 2, 10, 1), (9, 2, 4, 2), (7, 3, 20, 1)])
def test_equals_brute_force_however_the_rows_come(spark, batches, fan, least_documents, least_chars):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.pmod(F.xxhash64("text"), F.lit(batches)))
    parts = [df.where(F.coalesce("batch", F.lit(0)) == i) for i in range(batches)]
    with intermediate_tables(spark):
        found = ld.drop_common_lines(
            df, least_documents=least_documents, least_chars=least_chars, batches=parts, fan=fan
        ).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows, least_documents, least_chars)


def test_levels_hold_fewer_than_fan_runs_and_settled_lines_are_counted_no_more(spark):
    with intermediate_tables(spark):
        runs = ld.LineRuns(spark, least_documents=3, fan=2)
        for i in range(7):
            texts = ["always"] * (3 if i == 0 else 1) + [f"batch {i}", "half" if i % 2 else ""]
            runs.add(ld.line_counts(spark.createDataFrame([(t,) for t in texts], "text string")))
            assert all(len(level) < 2 for level in runs.levels)
        assert [len(level) for level in runs.levels] == [1, 1, 1]
        listed = [spark.table(name).collect() for name in runs.runs()]
        # 'always' was settled by the first batch: one row in one run
        assert Counter(r["documents"] for run in listed for r in run if r["documents"] >= 3) == {3: 1}
        assert runs.close().count() == 2 and runs.runs() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("table_")]


def test_runs_meet_without_a_shuffle(spark):
    with intermediate_tables(spark):
        runs = ld.LineRuns(spark, least_documents=2, fan=4)
        some = spark.createDataFrame([("a\nb",), ("a\nc",)], "text string")
        runs.add(ld.line_counts(some))
        runs.add(ld.line_counts(some))
        merged = runs._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in merged and "SortMergeJoin" in merged
        fresh = ld.line_counts(some)
        settled = spark.table(runs.runs()[0]).where("documents >= 2")
        plan = fresh.join(settled.hint("merge"), ld.HASH, "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_files_are_read_by_one_batch_each(spark, tmp_path):
    rows = some_rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    docs = read_table(spark, str(tmp_path), "documents")
    batches = ld.batches_of_files(docs, 3)
    assert len(batches) == 3 and sum(b.count() for b in batches) == len(rows)
    assert sum(len(set(r[0] for r in b.select("_metadata.file_name").collect())) for b in batches) == 7


def test_messy_rows(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    found = ld.drop_common_lines(messy, least_documents=2).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows, 2)
    assert ld.drop_common_lines(messy.limit(0)).count() == 0


def test_a_text_of_very_many_common_lines(spark):
    text = "\n".join(f"line {i}" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nlast")], "doc_id long, text string")
    found = sorted(map(tuple, ld.drop_common_lines(df, least_documents=2).collect()))
    assert found == [(1, 40_000, 40_000, ""), (2, 40_001, 40_000, "last")]
