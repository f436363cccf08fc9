import duckdb
import pytest

import __spark_entry__ as contract
from lossgauge.llm import queries


def test_every_operator_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert set(queries.ORACLES) <= set(contract.oracle_sql()) and "pipeline" not in contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = database.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    found = queries.QUERIES[name](spark, small).select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.select(*columns).fetchall())
