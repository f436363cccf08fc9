"""Queries for aggregations, top lists and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossgauge.catalog.registry import ORDERS_OF_CUSTOMERS, orders_of_customers, q, query, tidied
from lossgauge.operators import clean, reshape, summarize
from lossgauge.plans.loss_explorer import LossExplorer
from lossgauge.sources.delimited import read_table


@query(f"SELECT o_orderpriority, {q('avg(o_totalprice)')} AS o_totalprice FROM orders GROUP BY 1")
def mean_by_key(spark, sf):
    return tidied(summarize.mean_by(read_table(spark, sf, "orders"), ["o_orderpriority"], ["o_totalprice"]), ["o_totalprice"])


@query(
    f"""
    SELECT l_returnflag, l_linestatus, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year,
           {q('avg(l_extendedprice)')} AS l_extendedprice
    FROM lineitem GROUP BY ALL
    """
)
def mean_multi_key(spark, sf):
    lines = read_table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    means = summarize.mean_by(lines, ["l_returnflag", "l_linestatus", "l_linenumber", "year"], ["l_extendedprice"])
    return tidied(means, ["l_extendedprice"])


@query(
    f"""
    SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, {q('avg(o_totalprice)')} AS o_totalprice,
           {q('avg(o_custkey)')} AS o_custkey
    FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL
    """
)
def line_means(spark, sf):
    orders = read_table(spark, sf, "orders").select(
        "o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice", "o_custkey"
    )
    means = summarize.mean_by(clean.drop_group(orders, "o_orderpriority", "5-LOW"), ["o_orderpriority", "year"])
    return tidied(means, ["o_totalprice", "o_custkey"])


@query(
    """
    SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(o_orderkey) AS o_orderkey,
           count(nullif(o_orderstatus, 'P')) AS o_orderstatus,
           count(CASE WHEN o_totalprice > 250000 THEN o_totalprice END) AS o_totalprice
    FROM orders GROUP BY ALL
    """
)
def count_per_column(spark, sf):
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.year("o_orderdate").alias("year"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice")).alias("o_totalprice"),
    )
    return summarize.count_by(orders, ["o_orderpriority", "year"])


TOP = """
    WITH counts AS (SELECT {column}, count(*) AS n FROM {table} WHERE {where} GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, {column}) AS rn, sum(n) OVER () AS total FROM counts),
    shown AS (
      SELECT CASE WHEN rn <= {top} THEN {column} ELSE 'Others' END AS {column}, CAST(sum(n) AS BIGINT) AS n,
             max(total) AS total
      FROM ranked GROUP BY 1)
    SELECT {column}, n, {share} AS share, CAST(round_even(n * 1000.0::DOUBLE / total, 0) / 10 AS VARCHAR) || '%' AS percent
    FROM shown
"""


@query(TOP.format(column="p_brand", table="part", where="p_size > 0", top=7, share=q("n * 1.0::DOUBLE / total", 8)))
def topn_others(spark, sf):
    explorer = LossExplorer(read_table(spark, sf, "part"), entity="p_type", year="p_size", measure="p_size")
    return tidied(explorer.frequencies("p_brand"), ["share"], 8)


@query(
    TOP.format(column="event_type", table="events", where="value > 0", top=7, share=q("n * 1.0::DOUBLE / total", 8))
    + " WHERE event_type <> 'view'"
)
def topn_bars(spark, sf):
    events = clean.replace_values(read_table(spark, sf, "events"), "event_type", {"view": "Nan"})
    explorer = LossExplorer(events, entity="user_id", year="ts", measure="value")
    return tidied(explorer.bars("event_type"), ["share"], 8)


@query(
    """
    WITH counts AS (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT n_name, c_mktsegment AS segment FROM counts
    QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY n DESC, c_mktsegment) = 1
    """
)
def mode_by_group(spark, sf):
    nation = read_table(spark, sf, "nation")
    customers = read_table(spark, sf, "customer").join(nation, F.col("c_nationkey") == nation.n_nationkey)
    return summarize.mode_by(customers, ["n_name"], "c_mktsegment", "segment")


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           greatest(nullif(l_discount, 0), nullif(l_tax, 0)) AS loading
    FROM lineitem
    """
)
def loading_max(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    return summarize.row_max_ignoring_zero(lines, ["l_discount", "l_tax"], "loading").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "loading"
    )


@query(
    """
    SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
    UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders
    UNION ALL SELECT DISTINCT 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders
    """
)
def distinct_values(spark, sf):
    orders = read_table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return summarize.distinct_values(orders, ["o_orderstatus", "o_orderpriority", "year"])


@query(
    """
    SELECT 'year' AS "column", min(year(o_orderdate))::DOUBLE AS lowest, max(year(o_orderdate))::DOUBLE AS highest FROM orders
    UNION ALL SELECT 'o_totalprice', min(o_totalprice), max(o_totalprice) FROM orders
    """
)
def min_max(spark, sf):
    orders = read_table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return summarize.min_max(orders, ["year", "o_totalprice"])


@query("SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (o_totalprice > 250000) AS large FROM orders GROUP BY 1")
def row_and_flag_counts(spark, sf):
    orders = read_table(spark, sf, "orders").withColumn("large", F.col("o_totalprice") > 250000)
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.count_if("large").alias("large"))


@query(
    f"""
    WITH counts AS (
      SELECT r_name, year, count(o_totalprice) AS k FROM ({ORDERS_OF_CUSTOMERS}) GROUP BY ALL),
    ends AS (SELECT min(year) AS lo FROM counts)
    SELECT r_name, CAST(year - lo AS INTEGER) AS bin, year::DOUBLE AS bin_start, (year + 1)::DOUBLE AS bin_end,
           CAST(sum(k) AS BIGINT) AS total
    FROM counts, ends GROUP BY r_name, year, lo
    """
)
def histogram_sum(spark, sf):
    rows = orders_of_customers(spark, sf)
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    explorer = LossExplorer(rows, entity="n_name", measure="o_totalprice")
    return explorer.histogram("r_name", regions)


@query(
    f"""
    WITH ends AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS width FROM lineitem)
    SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / width), 19) AS INTEGER) AS bin,
           {q('sum(l_quantity)', 2)} AS total
    FROM lineitem, ends GROUP BY ALL
    """
)
def histogram_bins(spark, sf):
    bars = summarize.histogram_sum(
        read_table(spark, sf, "lineitem"), x="l_extendedprice", y="l_quantity", colour="l_returnflag", bins=20
    )
    return tidied(bars.select("l_returnflag", "bin", "total"), ["total"], 2)


BOX = """
    WITH samples AS (SELECT {by}, count(*) AS n, list({value} ORDER BY {value}) AS sorted FROM {table} GROUP BY 1),
    places AS (
      SELECT {by}, n, p, sorted, least(greatest({position}, 0), n - 1) AS place
      FROM samples, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS t(p)),
    quartiles AS (
      SELECT {by}, n, p, sorted[CAST(floor(place) AS BIGINT) + 1] AS lo, sorted[CAST(ceil(place) AS BIGINT) + 1] AS hi, place - floor(place) AS part
      FROM places),
    boxes AS (
      SELECT {by}, n, max(lo + (hi - lo) * part) FILTER (p = 0.25) AS q1, max(lo + (hi - lo) * part) FILTER (p = 0.5) AS median,
             max(lo + (hi - lo) * part) FILTER (p = 0.75) AS q3
      FROM quartiles GROUP BY {by}, n),
    marked AS (
      SELECT b.*, {value} AS v, {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM {table} r JOIN boxes b ON r.{by} = b.{by})
"""
BOX_RESULT = f"""
    SELECT {{by}}, n, {q('q1')} AS q1, {q('median')} AS median, {q('q3')} AS q3,
           {q('least(min(v) FILTER (inside), q1)')} AS lower_whisker,
           {q('greatest(max(v) FILTER (inside), q3)')} AS upper_whisker,
           count(*) FILTER (NOT inside) AS outliers
    FROM marked GROUP BY {{by}}, n, q1, median, q3
"""
BOX_COLUMNS = ["q1", "median", "q3", "lower_whisker", "upper_whisker"]


@query((BOX + BOX_RESULT).format(by="l_returnflag", value="l_extendedprice", table="lineitem", position="n * p - 0.5"))
def boxplot_stats(spark, sf):
    return tidied(summarize.box_plot(read_table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), BOX_COLUMNS)


@query((BOX + BOX_RESULT).format(by="event_type", value="value", table="events", position="(n - 1) * p"))
def boxplot_linear(spark, sf):
    boxes = summarize.box_plot(read_table(spark, sf, "events"), "event_type", "value", method="linear")
    return tidied(boxes, BOX_COLUMNS)


@query(
    BOX.format(by="event_type", value="value", table="events", position="n * p - 0.5")
    + """
    , whiskers AS (
      SELECT event_type, least(min(v) FILTER (inside), max(q1)) AS lower, greatest(max(v) FILTER (inside), max(q3)) AS upper
      FROM marked GROUP BY 1)
    SELECT event_type, event_id, value FROM events JOIN whiskers USING (event_type) WHERE value < lower OR value > upper
    """
)
def boxplot_outliers(spark, sf):
    events = read_table(spark, sf, "events").select("event_type", "event_id", "value")
    return summarize.box_plot_outliers(events, "event_type", "value", summarize.box_plot(events, "event_type", "value"))


@query(
    f"""
    WITH means AS (
      SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS y, avg(o_custkey) AS c
      FROM orders GROUP BY ALL),
    chosen AS (SELECT * FROM means WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW'))
    SELECT 'o_totalprice' AS "column", 1.0::DOUBLE AS corr
    UNION ALL SELECT 'o_custkey', {q('corr(y, c)', 6)} FROM chosen
    UNION ALL SELECT 'o_orderpriority_' || v, {q('corr(y, CASE WHEN o_orderpriority = v THEN 1.0 ELSE 0.0 END)', 6)}
    FROM chosen, (VALUES ('1-URGENT'), ('3-MEDIUM'), ('5-LOW')) AS t(v) GROUP BY v
    """
)
def onehot_corr(spark, sf):
    orders = read_table(spark, sf, "orders").select(
        "o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice", "o_custkey"
    )
    explorer = LossExplorer(orders, entity="o_custkey", measure="o_totalprice")
    found = explorer.correlation("o_orderpriority", ["1-URGENT", "3-MEDIUM", "5-LOW"])
    return tidied(found, ["corr"], 6)


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "o_orderstatus_F",
           CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O",
           CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P"
    FROM orders
    """
)
def one_hot_columns(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return reshape.one_hot(orders, "o_orderstatus", ["F", "O", "P"])


@query(
    f"""
    WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {q('(l_quantity - a) / (b - a)', 8)} AS l_quantity,
           {q('(l_extendedprice - c) / (d - c)', 8)} AS l_extendedprice
    FROM lineitem, e
    """
)
def minmax_scale(spark, sf):
    lines = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    scaled = summarize.scale_min_max(lines, ["l_quantity", "l_extendedprice"])
    return tidied(scaled, ["l_quantity", "l_extendedprice"], 8)


PANEL_ROWS = """SELECT n_name, year, c_mktsegment, o_custkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
                       CASE WHEN o_orderstatus <> 'P' THEN o_totalprice - 30000 END AS price FROM ({})""".format(ORDERS_OF_CUSTOMERS)
PICKED = ["BUILDING", "MACHINERY"]


@query(
    f"""
    WITH r AS ({PANEL_ROWS}), picked AS (SELECT * FROM r WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    m AS (SELECT c_mktsegment, year, avg(price) AS p, avg(o_custkey) AS c FROM picked GROUP BY 1, 2),
    k AS (SELECT c_mktsegment, count(*) AS n FROM r WHERE price > 0 GROUP BY 1),
    t AS (SELECT *, row_number() OVER (ORDER BY n DESC, c_mktsegment) <= 3 AS shown FROM k)
    SELECT 'map' AS panel, n_name AS "key", NULL::INTEGER AS year, 'price' AS "column", {q('avg(price)')} AS "value" FROM r GROUP BY 2
    UNION ALL SELECT 'year', NULL, year, 'price', {q('avg(price)')} FROM r GROUP BY 3
    UNION ALL SELECT 'year', NULL, year, 'o_custkey', {q('avg(o_custkey)')} FROM r GROUP BY 3
    UNION ALL SELECT 'top', CASE WHEN shown THEN c_mktsegment ELSE 'Others' END, NULL, 'n', {q('sum(n)')} FROM t GROUP BY 2
    UNION ALL SELECT 'lines', c_mktsegment, year, 'price', {q('p')} FROM m
    UNION ALL SELECT 'correlation', NULL, NULL, 'price', {q('1.0')}
    UNION ALL SELECT 'correlation', NULL, NULL, 'o_custkey', {q('corr(p, c)')} FROM m
    UNION ALL SELECT 'correlation', NULL, NULL, 'c_mktsegment_' || v, {q('corr(p, (c_mktsegment = v)::INTEGER)')}
        FROM m, (VALUES ('BUILDING'), ('MACHINERY')) AS s(v) GROUP BY v
    UNION ALL SELECT 'bars', c_mktsegment, year, 'price', {q('count(price)')} FROM picked GROUP BY 2, 3
    """
)
def explorer_panels(spark, sf):
    """The six panels of the explorer for one option, from a single pass."""
    rows = orders_of_customers(spark, sf).select(
        "n_name",
        "year",
        "c_mktsegment",
        "o_custkey",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") - 30000).alias("price"),
    )
    panels = LossExplorer(rows, entity="n_name", measure="price").panels("c_mktsegment")

    def long(panel, df, column, value, key=None, year=None):
        return df.select(
            F.lit(panel).alias("panel"),
            (F.col(key) if key else F.lit(None).cast("string")).alias("key"),
            (F.col(year) if year else F.lit(None)).cast("int").alias("year"),
            column.alias("column"),
            value.cast("double").alias("value"),
        )

    segment, price = "c_mktsegment", F.lit("price")
    years, bars = panels.year_means(), panels.histogram(PICKED)
    found = [
        long("map", panels.map_means(), price, F.col("price"), "n_name"),
        long("year", years, price, F.col("price"), year="year"),
        long("year", years, F.lit("o_custkey"), F.col("o_custkey"), year="year"),
        long("top", panels.frequencies(3), F.lit("n"), F.col("n"), segment),
        long("lines", panels.category_year_means(PICKED), price, F.col("price"), segment, "year"),
        long("correlation", panels.correlation(PICKED), F.col("column"), F.col("corr")),
        long("bars", bars, price, F.col("total"), segment, "bin_start"),
    ]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return tidied(whole, ["value"])
