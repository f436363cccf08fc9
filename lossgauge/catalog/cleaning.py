"""Queries for reading rules, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossgauge.catalog.registry import q, query, tidied
from lossgauge.functions import scalar
from lossgauge.operators import clean, enrich
from lossgauge.sources.delimited import read_table


@query(
    """
    WITH t AS (
      SELECT event_id, CASE WHEN event_type = 'error' THEN '..' WHEN event_type = 'view' THEN 'NA'
                            ELSE CAST(value AS VARCHAR) END AS raw,
             CASE WHEN event_type = 'signup' THEN 'NULL' ELSE event_type END AS kind
      FROM events)
    SELECT event_id, TRY_CAST(CASE WHEN raw NOT IN ('..', 'NA') THEN raw END AS DOUBLE) AS number,
           CASE WHEN kind <> 'NULL' THEN kind END AS kind FROM t
    """
)
def null_markers(spark, sf):
    events = read_table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "error", "..").when(F.col("event_type") == "view", "NA")
    texts = events.select(
        "event_id",
        raw.otherwise(F.col("value").cast("string")).alias("number"),
        F.when(F.col("event_type") == "signup", "NULL").otherwise(F.col("event_type")).alias("kind"),
    )
    blanked = clean.blank_missing(texts, ["number", "kind"], scalar.MISSING_MARKERS)
    return clean.numbers_from_text(blanked, ["number"], ("..",))


@query(
    """
    SELECT n_nationkey,
           CASE n_name WHEN 'NATION_3' THEN 'Third' WHEN 'NATION_4' THEN 'Fourth' ELSE n_name END AS n_name,
           CASE r_name WHEN 'AFRICA' THEN 'Africa' WHEN 'EUROPE' THEN 'Europe' ELSE r_name END AS r_name
    FROM nation JOIN region ON n_regionkey = r_regionkey
    """
)
def value_map(spark, sf):
    joined = enrich.attach_dimension(
        read_table(spark, sf, "nation"), read_table(spark, sf, "region"), "n_regionkey", "r_regionkey"
    ).select("n_nationkey", "n_name", "r_name")
    renamed = clean.replace_values(joined, "n_name", {"NATION_3": "Third", "NATION_4": "Fourth"})
    return clean.replace_values(renamed, "r_name", {"AFRICA": "Africa", "EUROPE": "Europe"})


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase', 'absent')")
def allow_list(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "event_type", "value")
    return clean.keep_values(events, "event_type", ["click", "purchase", "absent"])


@query(
    """
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')
    """
)
def allow_list_table(spark, sf):
    wanted = clean.filter_panel(read_table(spark, sf, "customer"), equal={"c_mktsegment": "FURNITURE"})
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return clean.keep_listed(orders, "o_custkey", wanted, "c_custkey").drop("o_custkey")


@query(
    """
    WITH t AS (SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_name END AS n_name FROM nation)
    SELECT * FROM t WHERE n_name IS NULL OR n_name NOT IN ('NATION_0', 'NATION_5', 'NATION_6')
    """
)
def deny_list(spark, sf):
    nation = read_table(spark, sf, "nation").select(
        "n_nationkey", F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("n_name")
    )
    return clean.drop_values(nation, "n_name", ["NATION_0", "NATION_5", "NATION_6"])


@query(
    """
    SELECT p_partkey, p_name, p_brand FROM part
    WHERE coalesce(contains(nullif(p_name, 'red ring'), 'ring'), false) AND regexp_matches(p_brand, '1[0-9]$')
    """
)
def substring_filter(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    part = part.withColumn("_name", F.nullif("p_name", F.lit("red ring")))
    named = clean.keep_matching(part, "_name", "ring").drop("_name")
    return clean.keep_matching(named, "p_brand", "1[0-9]$", regex=True)


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_tax FROM lineitem
    WHERE l_returnflag <> 'R' AND l_discount <> 0
    """
)
def dropna_any(spark, sf):
    lines = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_discount") != 0, F.col("l_tax")).alias("l_tax"),
    )
    return clean.drop_incomplete(lines)


@query(
    """
    SELECT DISTINCT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate)
    FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F')
    """
)
def dedup_rows(spark, sf):
    orders = read_table(spark, sf, "orders")
    rows = clean.drop_duplicate_rows(orders.unionByName(orders.filter("o_orderstatus = 'F'")))
    return rows.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("SELECT c_custkey, c_acctbal AS debt FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def sign_filters(spark, sf):
    customer = read_table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("debt"))
    rich = clean.keep_positive(customer.withColumn("_above", F.col("debt") - 5000), "_above").drop("_above")
    return clean.keep_negative(customer, "debt").unionByName(rich)


@query(
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS order_year,
           CAST(make_date(CAST(year(o_orderdate) AS INTEGER), 12, 31) AS VARCHAR) AS period_end,
           CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS text_year,
           string_split(o_orderpriority, '-')[1] AS first_part
    FROM orders
    """
)
def scalar_fns(spark, sf):
    orders = read_table(spark, sf, "orders")
    year = scalar.year_of(F.col("o_orderdate"))
    return orders.select(
        "o_orderkey",
        year.alias("order_year"),
        scalar.year_end(year).cast("string").alias("period_end"),
        scalar.leading_year(F.col("o_orderdate").cast("string")).alias("text_year"),
        scalar.first_item(F.split("o_orderpriority", "-")).alias("first_part"),
    )


@query(
    """
    SELECT p_partkey, p_size, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th'
             WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd'
             ELSE 'th' END AS size_label,
           rtrim(p_type) AS p_type, p_retailprice
    FROM part
    """
)
def text_labels(spark, sf):
    part = read_table(spark, sf, "part").select(
        "p_partkey",
        "p_size",
        scalar.ordinal_label(F.col("p_size")).alias("size_label"),
        F.concat("p_type", F.lit("  ")).alias("p_type"),
        F.regexp_replace(F.col("p_retailprice").cast("string"), "\\.", ",").alias("p_retailprice"),
    )
    part = clean.trim_texts(part, ["p_type"])
    return part.withColumn("p_retailprice", scalar.decimal_comma(F.col("p_retailprice")))


@query(
    f"""
    SELECT l_returnflag AS flag, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS amount,
           {q('l_extendedprice * (1 - l_discount)', 2)} AS net
    FROM lineitem
    """
)
def project_rename_cast(spark, sf):
    lines = read_table(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_linenumber",
        "l_quantity",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )
    named = clean.rename_all(lines, ["flag", "line", "amount", "net"])
    return tidied(clean.cast_columns(named, {"line": "bigint"}), ["net"], 2)


@query(
    """
    SELECT p_partkey, p_type, CASE WHEN p_size > 25 THEN p_retailprice END AS price FROM part
    """
)
def nan_values(spark, sf):
    part = read_table(spark, sf, "part").select(
        "p_partkey",
        "p_type",
        F.when(F.col("p_size") > 25, F.col("p_retailprice")).otherwise(F.lit(float("nan"))).alias("price"),
    )
    return clean.nulls_for_nan(part)
