"""Joins on keys that a third of the rows share are split at run time."""

import pytest
from pyspark.sql import functions as F

from lossgauge.llm import exact_dedup, line_dedup, simhash
from lossgauge.session import stable

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
}


@pytest.fixture
def split_early(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def watched(monkeypatch, module):
    """The final plans of all tables that a module stores."""
    plans = []

    def watching(df):
        plans.append(final_plan(df))
        return stable(df)

    monkeypatch.setattr(module, "stable", watching)
    return plans


def test_blocks_and_pairs_that_many_documents_share(spark, split_early, monkeypatch):
    plans = watched(monkeypatch, exact_dedup)
    texts = ["same" * 8 if i % 3 == 0 else f"{i:032d}" for i in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = exact_dedup.exact_duplicates(df, block_bytes=16)
    plans.append(final_plan(found))
    assert found.where("group_size = 2000").count() == 2000
    joins = [p for p in plans if "SortMergeJoin" in p]
    for keys in ("[h#", "[left#"):
        assert any("skew=true" in line and keys in line for p in joins for line in p.splitlines()), keys


def test_hubs_and_large_components(spark, split_early, monkeypatch):
    plans = watched(monkeypatch, simhash)
    edges = spark.range(1, 9000, 1, 8).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    found = simhash.components(edges)
    assert found.where("component = 0").count() == 9000
    assert any("skew=true" in line and "[a#" in line for p in plans for line in p.splitlines())


def test_lines_of_a_text_with_very_many_copies(spark, split_early):
    # equal rows are small once compressed: few others beside them
    rows = [(None, "common\nown") for _ in range(9000)] + [(i, f"common\nline {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = line_dedup.drop_common_lines(df)
    plan = final_plan(found)
    assert "skew=true" in plan
    assert found.where("doc_id IS NULL AND n_dropped = 2").count() == 9000
