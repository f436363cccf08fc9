"""Every catalogue query against its SQL on the smallest tables, and the shape of some plans."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from lossgauge.catalog import QUERIES
from lossgauge.operators import ordered
from lossgauge.sources.delimited import read_table

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    frame = frame.astype(object).where(frame.notna(), None)
    return list(frame.columns), sorted(map(tuple, frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    found = plain(contract.queries()[name](spark, FOLDER).toPandas())
    assert found == plain(database.sql(contract.oracle_sql()[name]).df())


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan_of(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    return text


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, QUERIES["filter_panel"](spark, FOLDER))
    scans = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: (\S+)", plan)
    filters, columns = next(s for s in scans if "o_orderstatus" in s[1])
    assert "EqualTo(o_orderstatus,F)" in filters and "GreaterThanOrEqual(o_orderdate" in filters
    assert "o_totalprice" not in columns and "l_tax" not in plan
    assert "BroadcastHashJoin" in plan
    # lines are deduplicated after the join, over a shuffle of whole rows
    shuffles = re.findall(r"Exchange hashpartitioning\((.*), 8\), (\w+)", plan)
    assert any(kind == "REPARTITION_BY_COL" and "l_linenumber" in keys for keys, kind in shuffles)
    assert plan.index("REPARTITION_BY_COL") < plan.index("BroadcastHashJoin")


@pytest.mark.parametrize(
    "name", ["topn_others", "boxplot_stats", "ffill_global", "ffill_by_entity", "profile_topk", "catalogue_ranked"]
)
def test_no_window_in_a_single_task(spark, name):
    plan = plan_of(spark, QUERIES[name](spark, FOLDER))
    windows = re.findall(r"Window \[(.*)\n.*Sort \[.*\n(.*)", plan)
    # the state of whole blocks, one row each, may meet in one task
    assert not any("SinglePartition" in below and "_last_" not in window for window, below in windows)


def test_hot_groups_are_split_by_block(spark):
    orders = read_table(spark, FOLDER, "orders")
    arguments = dict(partition_by=["o_orderpriority"], order_by=["o_orderkey"])
    hot = ordered.forward_fill(orders, ["o_totalprice"], **arguments, group_limit=100)
    even = ordered.forward_fill(orders, ["o_totalprice"], **arguments)
    assert re.search(r"Exchange hashpartitioning\(o_orderpriority#\d+, _block#\d+", plan_of(spark, hot))
    assert ordered.BLOCK not in plan_of(spark, even)
