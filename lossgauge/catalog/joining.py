"""Queries for joins and the flagship filter panel."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lossgauge.catalog.registry import q, query, tidied
from lossgauge.operators import clean, enrich, summarize
from lossgauge.plans.loss_explorer import LossExplorer
from lossgauge.sources.delimited import read_table

PANEL_NAMES = {"NATION_1": "First", "NATION_2": "Second"}
PANEL_DENIED = ("NATION_9", "NATION_19")


def panel_rows(spark, sf):
    """Loss-explorer rows: one per distinct line item, with order date, status, nation and region.

    Orders are enriched and filtered before the lines join them, in a join that adaptive execution can split where
    an order is hot. Duplicates go after it, so that only lines which the panel keeps are shuffled by the whole
    row; that shuffle is stated, as the join's partitioning would do for the deduplication and tie the two together.
    """
    lines = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = enrich.attach_dimension(
        read_table(spark, sf, "nation"), read_table(spark, sf, "region"), "n_regionkey", "r_regionkey"
    ).drop("n_regionkey")
    enriched = enrich.attach_dimension(orders, customers, "o_custkey", "c_custkey")
    enriched = enrich.attach_dimension(enriched, nations, "c_nationkey", "n_nationkey").drop("c_nationkey")
    renamed = clean.replace_values(enriched, "n_name", PANEL_NAMES)
    kept = clean.drop_values(renamed, "n_name", PANEL_DENIED)
    joined = enrich.attach_dimension(lines, kept, "l_orderkey", "o_orderkey")
    return clean.drop_duplicate_rows(joined.repartition(*joined.columns))


@query(
    f"""
    WITH lines AS (
      SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
    joined AS (
      SELECT CASE n_name WHEN 'NATION_1' THEN 'First' WHEN 'NATION_2' THEN 'Second' ELSE n_name END AS nation,
             l_extendedprice
      FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1996 AND 1999)
    SELECT nation, {q('avg(l_extendedprice)')} AS mean_price FROM joined
    WHERE nation NOT IN ('NATION_9', 'NATION_19') GROUP BY nation
    """
)
def filter_panel(spark, sf):
    explorer = LossExplorer(panel_rows(spark, sf), entity="n_name", year="o_orderdate", measure="l_extendedprice")
    years = (datetime(1996, 1, 1), datetime(1999, 12, 31, 23, 59, 59))
    chosen = explorer.choose(years=years, o_orderstatus="F", r_name=clean.ALL)
    means = chosen.map_means().withColumnsRenamed({"n_name": "nation", "l_extendedprice": "mean_price"})
    return tidied(means, ["mean_price"])


@query(
    """
    WITH renames AS (SELECT n_name AS old, 'Country ' || substr(n_name, 8) AS new FROM nation WHERE n_regionkey < 3)
    SELECT c_custkey, r.new AS country FROM customer JOIN nation n ON c_nationkey = n_nationkey
    LEFT JOIN renames r ON r.old = n.n_name
    """
)
def lookup_rename(spark, sf):
    nation = read_table(spark, sf, "nation")
    renames = nation.filter("n_regionkey < 3").select(
        F.col("n_name").alias("old"), F.concat(F.lit("Country "), F.expr("substr(n_name, 8)")).alias("new")
    )
    customers = enrich.attach_dimension(read_table(spark, sf, "customer"), nation, "c_nationkey", "n_nationkey")
    named = customers.select("c_custkey", F.col("n_name").alias("country"))
    return enrich.lookup_rename(named, "country", renames, "old", "new")


@query(
    """
    SELECT CAST(CASE WHEN o_orderkey % 50 > 0 THEN o_custkey END AS VARCHAR) AS buyer, count(*) AS n FROM orders
    WHERE buyer IS NULL OR buyer NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0) GROUP BY 1
    """
)
def unmatched_names(spark, sf):
    buyer = F.when(F.col("o_orderkey") % 50 > 0, F.col("o_custkey").cast("string")).alias("buyer")
    orders = read_table(spark, sf, "orders").select(buyer)
    known = read_table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string"))
    return enrich.unmatched(orders, known, "buyer", "c_custkey")


@query(
    """
    WITH lost AS (
        SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS buyer FROM orders
        WHERE o_orderkey % 50 > 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
    SELECT buyer, CAST(c_custkey AS VARCHAR) AS candidate, CAST(levenshtein(buyer, CAST(c_custkey AS VARCHAR)) AS INTEGER) AS distance
    FROM lost, customer WHERE c_acctbal > 0 AND levenshtein(buyer, CAST(c_custkey AS VARCHAR)) <= 1
    """
)
def name_suggestions(spark, sf):
    """Known customers whose key is one edit away from a buyer that the join would lose."""
    known = read_table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string"))
    return enrich.suggest_names(unmatched_names(spark, sf), known, "buyer", "c_custkey", most=1)


@query(
    """
    SELECT o_orderkey, o_totalprice, c_mktsegment, n_name, r_name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    """
)
def enrich_star(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = enrich.attach_dimension(orders, customers, "o_custkey", "c_custkey")
    joined = enrich.attach_dimension(joined, read_table(spark, sf, "nation"), "c_nationkey", "n_nationkey")
    joined = enrich.attach_dimension(joined, read_table(spark, sf, "region"), "n_regionkey", "r_regionkey")
    return joined.drop("o_custkey", "c_nationkey", "n_regionkey")


@query(
    f"""
    WITH ordered AS (
      SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS price
      FROM orders GROUP BY ALL),
    shipped AS (
      SELECT o_custkey AS buyer, CAST(year(l_shipdate) AS INTEGER) AS ship_year, avg(l_quantity) AS quantity
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT customer, year, {q('price')} AS price, {q('quantity')} AS quantity
    FROM ordered JOIN shipped ON customer = buyer AND year = ship_year
    """
)
def two_fact_join(spark, sf):
    orders = read_table(spark, sf, "orders")
    lines = read_table(spark, sf, "lineitem").select(
        "l_orderkey", F.year("l_shipdate").alias("ship_year"), F.col("l_quantity").alias("quantity")
    )
    ordered = summarize.mean_by(
        orders.select(
            F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price")
        ),
        ["customer", "year"],
        ["price"],
    )
    bought = enrich.attach_dimension(
        lines, orders.select("o_orderkey", F.col("o_custkey").alias("buyer")), "l_orderkey", "o_orderkey"
    )
    shipped = summarize.mean_by(bought, ["buyer", "ship_year"], ["quantity"])
    joined = enrich.join_facts(ordered, shipped, ["customer", "year"], ["buyer", "ship_year"])
    return tidied(joined.drop("buyer", "ship_year"), ["price", "quantity"])
