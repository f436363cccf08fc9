"""Queries for reshaping, resampling, densifying and filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossgauge.catalog.registry import q, query, tidied
from lossgauge.operators import ordered, panel, reshape, summarize
from lossgauge.sources.delimited import read_table

YEARS = list(range(1995, 2002))


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'quantity' AS series, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'discount', l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'tax', l_tax FROM lineitem
    """
)
def wide_to_long(spark, sf):
    lines = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return reshape.wide_to_long(lines, ids, ["quantity", "discount", "tax"], "series", "value")


def _price_years(spark, sf):
    """(customer, year, price): mean order price."""
    orders = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price")
    )
    return summarize.mean_by(orders, ["customer", "year"], ["price"])


@query(
    "WITH m AS (SELECT o_custkey AS customer, year(o_orderdate) AS year, avg(o_totalprice) AS price FROM orders GROUP BY ALL)\n"
    "SELECT customer, "
    + ", ".join(f'{q(f"max(price) FILTER (year = {y})")} AS "{y}"' for y in YEARS)
    + " FROM m GROUP BY customer"
)
def long_to_wide(spark, sf):
    wide = reshape.long_to_wide(_price_years(spark, sf), ["customer"], "year", "price", YEARS)
    return tidied(wide, [str(y) for y in YEARS])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    """
    WITH m AS (
      SELECT o_orderpriority AS series, c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS price
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT nation, year, """
    + ", ".join(f"""{q(f"max(price) FILTER (series = '{p}')")} AS "{p}" """ for p in PRIORITIES)
    + " FROM m GROUP BY nation, year"
)
def year_stack(spark, sf):
    orders = read_table(spark, sf, "orders")
    customer = read_table(spark, sf, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderpriority").alias("series"),
        F.col("c_nationkey").alias("nation"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("price"),
    )
    means = summarize.mean_by(rows, ["nation", "series", "year"], ["price"])
    wide = reshape.long_to_wide(means, ["nation", "series"], "year", "price", YEARS)
    columns = {str(y): y for y in YEARS}
    stacked = reshape.stack_years(wide, entity="nation", series="series", years=columns, labels=PRIORITIES)
    return tidied(stacked.dropna("all", subset=PRIORITIES), PRIORITIES)


RAW = """
    SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS position,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
           CASE WHEN o_orderpriority < '4' THEN o_orderpriority END AS priority
    FROM orders
"""
YEARLY = f"""
    WITH raw AS ({RAW}),
    yearly AS (
      SELECT customer, year, arg_max(price, position) FILTER (price IS NOT NULL) AS price,
             arg_max(priority, position) FILTER (priority IS NOT NULL) AS priority
      FROM raw GROUP BY ALL),
    span AS (SELECT customer, unnest(generate_series(min(year), max(year))) AS year FROM yearly GROUP BY customer),
    dense AS (
      SELECT customer, CAST(s.year AS INTEGER) AS year, price, priority
      FROM span s LEFT JOIN yearly y USING (customer, year))
"""


def _raw(spark, sf):
    return read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderkey").alias("position"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderpriority") < "4", F.col("o_orderpriority")).alias("priority"),
    )


def _yearly(spark, sf):
    return panel.resample_last(
        _raw(spark, sf), entity="customer", year="year", order_by=["position"], columns=["price", "priority"]
    )


@query(YEARLY + "SELECT * FROM yearly")
def resample_last(spark, sf):
    return _yearly(spark, sf)


@query(YEARLY + "SELECT * FROM dense")
def densify_years(spark, sf):
    return panel.densify_years(_yearly(spark, sf), entity="customer", year="year")


@query(
    f"""
    WITH raw AS ({RAW})
    SELECT customer, year, position,
           last_value(price IGNORE NULLS) OVER w AS price, last_value(priority IGNORE NULLS) OVER w AS priority
    FROM raw WINDOW w AS (PARTITION BY customer ORDER BY year, position ROWS UNBOUNDED PRECEDING)
    """
)
def ffill_by_entity(spark, sf):
    return ordered.forward_fill(
        _raw(spark, sf), ["price", "priority"], partition_by=["customer"], order_by=["year", "position"]
    )


@query(
    f"""
    WITH raw AS ({RAW})
    SELECT customer, year, position,
           last_value(price IGNORE NULLS) OVER w AS price, last_value(priority IGNORE NULLS) OVER w AS priority
    FROM raw WINDOW w AS (ORDER BY customer, year, position ROWS UNBOUNDED PRECEDING)
    """
)
def ffill_global(spark, sf):
    return ordered.forward_fill(_raw(spark, sf), ["price", "priority"], order_by=["customer", "year", "position"])


@query(
    YEARLY
    + f"""
    , filled AS (
      SELECT customer, year, last_value(priority IGNORE NULLS) OVER (PARTITION BY customer ORDER BY year ROWS UNBOUNDED PRECEDING) AS priority
      FROM dense),
    measured AS (SELECT customer, year, priority, avg(price) AS price FROM raw WHERE priority IS NOT NULL GROUP BY ALL)
    SELECT customer, year, priority, {q('m.price')} AS price
    FROM filled f JOIN measured m USING (customer, year, priority)
    """
)
def densify_remerge(spark, sf):
    raw = _raw(spark, sf)
    measured = summarize.mean_by(raw, ["customer", "year", "priority"], ["price"])
    filled = panel.densify_and_reattach(
        raw,
        measured,
        entity="customer",
        year="year",
        order_by=["position"],
        columns=["price", "priority"],
        keys=["customer", "year", "priority"],
        measure="price",
    )
    return tidied(filled, ["price"])
