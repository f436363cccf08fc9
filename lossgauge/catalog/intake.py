"""Queries for reading delimited text with rejects, and for the layout of stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossgauge.catalog.registry import ORDERS_OF_CUSTOMERS, orders_of_customers, q, query, tidied
from lossgauge.operators import layout
from lossgauge.session import intermediate_folder
from lossgauge.sources.delimited import read_delimited_checked, read_table


def _damaged_orders(spark, sf) -> str:
    """The orders as lines of text; some prices are words, some years misspelt, some lines have too many or few fields."""
    key = F.col("o_orderkey")
    price = F.when(key % 17 == 3, "unknown").when(key % 13 == 5, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    year = F.year("o_orderdate").cast("string")
    year = F.when(key % 29 == 7, F.concat(F.lit("x"), year)).otherwise(year)
    note = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('; said ""so""'), F.lit('"'))
    few = F.concat_ws(";", key.cast("string"), price)
    whole = F.concat_ws(";", key.cast("string"), price, year, note)
    line = F.when(key % 31 == 2, few).when(key % 37 == 4, F.concat(whole, F.lit(";more"))).otherwise(whole)
    folder = intermediate_folder(spark)
    read_table(spark, sf, "orders").select(line.alias("value")).write.text(folder)
    return folder


@query(f"""
    WITH o AS (
        SELECT *, o_orderkey % 31 = 2 OR o_orderkey % 37 = 4 AS misfit, o_orderkey % 17 = 3 AS bad_price, o_orderkey % 29 = 7 AS bad_year,
               o_orderkey % 13 = 5 AND NOT bad_price AS no_price FROM orders)
    , j AS (
        SELECT *, CASE WHEN misfit THEN 'wrong number of fields' WHEN bad_price AND bad_year THEN 'unreadable: price, year'
                       WHEN bad_price THEN 'unreadable: price' WHEN bad_year THEN 'unreadable: year' END AS reason
        FROM o)
    SELECT reason, CASE WHEN reason IS NULL THEN o_orderpriority || '; said "so"' END AS note,
           count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS orders,
           {q("sum(CASE WHEN reason IS NULL AND NOT no_price THEN o_totalprice END)", 2)} AS price
    FROM j GROUP BY ALL
""")
def rejected_rows(spark, sf):
    """Good and rejected lines of a damaged file of the orders: each line in one of the two."""
    names = ["order", "price", "year", "note"]
    types = {"order": "bigint", "price": "double", "year": "int"}
    good, rejected = read_delimited_checked(spark, _damaged_orders(spark, sf), types=types, names=names, sep=";")
    kept = good.groupBy(F.lit(None).cast("string").alias("reason"), "note").agg(
        F.count(F.lit(1)).alias("n"), F.sum("order").alias("orders"), F.sum("price").alias("price")
    )
    key = F.col("fields")["order"].cast("bigint")
    lost = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("orders"))
    missing = {"note": F.lit(None).cast("string"), "price": F.lit(None).cast("double")}
    return tidied(kept.unionByName(lost.withColumns(missing)), ["price"], 2)


@query(f"""
    SELECT r_name, year, c_mktsegment, count(*) AS n, {q("sum(o_totalprice)", 2)} AS price FROM ({ORDERS_OF_CUSTOMERS})
    WHERE r_name IN ('ASIA', 'EUROPE') OR year BETWEEN 1996 AND 1997 GROUP BY ALL
""")
def z_ordered_rows(spark, sf):
    """Orders stored by region, year and segment, and read back through filters on one of them."""
    rows = orders_of_customers(spark, sf)
    folder = intermediate_folder(spark)
    layout.write_z_ordered(rows, folder, ["r_name", "year", "c_mktsegment"], files=16, bits=4)
    stored = spark.read.schema(rows.schema).parquet(folder)
    chosen = stored.filter(F.col("r_name").isin("ASIA", "EUROPE") | F.col("year").between(1996, 1997))
    found = chosen.groupBy("r_name", "year", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price")
    )
    return tidied(found, ["price"], 2)
