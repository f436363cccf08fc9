"""Registry of catalogue queries: a Spark query and, beside it, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossgauge.sources.delimited import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Sums differ in their last digits between engines. Values are cut to a few decimals on both sides; the
# small offset keeps exact halves, common in means of prices, on the same side.
HALF = 0.5001


def query(sql: str | None = None):
    """Register a function under its own name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def tidy(col: Column | str, digits: int = 4) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col * 10.0**digits + HALF) / 10.0**digits


def q(expression: str, digits: int = 4) -> str:
    """The SQL of ``tidy``."""
    return f"(floor(({expression}) * {10.0**digits} + {HALF}) / {10.0**digits})"


def tidied(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    return df.withColumns({c: tidy(c, digits) for c in columns})


def orders_of_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with year, customer segment, nation and region."""
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
        F.year("o_orderdate").alias("year"),
    )
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf, "nation")
    region = read_table(spark, sf, "region")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
        .drop("c_custkey", "n_nationkey", "r_regionkey", "n_regionkey", "c_nationkey")
    )


ORDERS_OF_CUSTOMERS = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
           CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment, n_name, r_name
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
