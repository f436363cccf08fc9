"""The three analyses end to end, on whole tables shaped like their inputs.

Countries are nations, commodities are order priorities, supply stages follow the market segment, series follow the
order priority. Derived gaps exercise the fills.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lossgauge.catalog.registry import q, query, tidied
from lossgauge.functions.scalar import map_values
from lossgauge.operators.enrich import attach_dimension
from lossgauge.plans import labels
from lossgauge.plans import policy_ranking as ranking
from lossgauge.plans.indicator_explorer import IndicatorExplorer, prepare_indicators
from lossgauge.plans.loss_explorer import LossExplorer, prepare_losses
from lossgauge.sources.delimited import read_table

SEGMENT_STAGES = {
    "AUTOMOBILE": "Storage",
    "BUILDING": "Transport",
    "FURNITURE": "Market",
    "HOUSEHOLD": "Packing",
    "MACHINERY": "Farm",
}
# the overall score and the six categories, by the first digit of the priority and the parity of the year
PRIORITY_SERIES = dict(enumerate(labels.SCORE_SERIES[:5], 1))
ORDER_YEARS = dict(zip(range(1996, 2002), labels.YEAR_COLUMNS))
NAMES = {"NATION_1": "First", "NATION_2": "Second"}
DENIED = ("NATION_9", "NATION_19")


def _case(column: str, mapping) -> str:
    rules = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {rules} ELSE {column} END"


def _orders(spark, sf):
    """(country, region key, commodity, stage, year, price, key) of all orders."""
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderpriority"
    )
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = attach_dimension(orders, customers, "o_custkey", "c_custkey")
    rows = attach_dimension(rows, read_table(spark, sf, "nation"), "c_nationkey", "n_nationkey")
    return rows.select(
        F.col("n_name").alias("country"),
        "year",
        F.col("o_orderpriority").alias("commodity"),
        map_values(F.col("c_mktsegment"), SEGMENT_STAGES).alias("food_supply_stage"),
        F.col("o_totalprice").alias("loss_percentage"),
        F.col("o_orderkey").alias("m49_code"),
    )


ORDERS = f"""
    SELECT n_name AS country, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS commodity,
           {_case('c_mktsegment', SEGMENT_STAGES)} AS food_supply_stage, o_totalprice AS loss_percentage, o_orderkey AS m49_code
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def _countries(spark, sf):
    """(Country, Region, Income) under the new names; one country is missing, one has no income."""
    nations = attach_dimension(
        read_table(spark, sf, "nation"), read_table(spark, sf, "region"), "n_regionkey", "r_regionkey"
    )
    income = F.when(F.col("n_name") == "NATION_5", "Nan").when(F.col("n_nationkey") % 2 == 0, "Upper").otherwise("Lower")
    return nations.filter("n_name <> 'NATION_7'").select(
        map_values(F.col("n_name"), NAMES).alias("Country"), F.col("r_name").alias("Region"), income.alias("Income")
    )


COUNTRIES = f"""
    SELECT {_case('n_name', NAMES)} AS place, r_name AS Region,
           CASE WHEN n_name = 'NATION_5' THEN 'Nan' WHEN n_nationkey % 2 = 0 THEN 'Upper' ELSE 'Lower' END AS Income
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_7'
"""


def _commodities(spark, sf):
    names = read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("Commodities")).distinct()
    return names.withColumn("Commodity Groups", F.when(F.col("Commodities") < "3", "High").otherwise("Low"))


COMMODITIES = """
    SELECT DISTINCT o_orderpriority AS Commodities, CASE WHEN o_orderpriority < '3' THEN 'High' ELSE 'Low' END AS "Commodity Groups"
    FROM orders
"""


@query(
    f"""
    WITH raw AS ({ORDERS}), countries AS ({COUNTRIES}), commodities AS ({COMMODITIES}),
    named AS (
      SELECT {_case('country', NAMES)} AS country, year, commodity,
             CASE WHEN m49_code % 5 > 0 THEN loss_percentage END AS loss_percentage,
             CASE WHEN m49_code % 7 > 0 THEN food_supply_stage END AS food_supply_stage, m49_code
      FROM raw WHERE country NOT IN ('NATION_9', 'NATION_19')),
    filled AS (
      SELECT country, year, Region, Income, "Commodity Groups" AS grouped, m49_code,
             last_value(loss_percentage IGNORE NULLS) OVER w AS loss, last_value(food_supply_stage IGNORE NULLS) OVER w AS stage
      FROM named JOIN countries ON country = place JOIN commodities ON commodity = Commodities
      WINDOW w AS (PARTITION BY country ORDER BY year, m49_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT CASE Income WHEN 'Nan' THEN 'Lower-Middle Income Economies' ELSE Income END AS income, year, grouped, stage,
           count(*) AS n, count(loss) AS known, {q('avg(loss)')} AS mean_loss
    FROM filled WHERE year BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3, 4
    """
)
def prepared_losses(spark, sf):
    """Losses cleaned, enriched and filled, then narrowed to some years."""
    rows = _orders(spark, sf).withColumns(
        {
            "loss_percentage": F.when(F.col("m49_code") % 5 > 0, F.col("loss_percentage")),
            "food_supply_stage": F.when(F.col("m49_code") % 7 > 0, F.col("food_supply_stage")),
        }
    )
    prepared = prepare_losses(
        rows, _countries(spark, sf), _commodities(spark, sf), names=NAMES, denied=DENIED, fill_order=("year", "m49_code")
    )
    chosen = LossExplorer(prepared).choose(years=(1996, 1999)).rows
    means = chosen.groupBy(
        F.col("Income").alias("income"), "year", F.col("Commodity Groups").alias("grouped"), F.col("food_supply_stage").alias("stage")
    ).agg(F.count(F.lit(1)).alias("n"), F.count("loss_percentage").alias("known"), F.avg("loss_percentage").alias("mean_loss"))
    return tidied(means, ["mean_loss"])


def _indicators(spark, sf):
    """Number of orders as text, one column per year; no text and the mark '..' where the number says so."""
    series = map_values(F.substring("commodity", 1, 1), {str(k): v for k, v in PRIORITY_SERIES.items()})
    rows = _orders(spark, sf).select("country", "year", series.alias("series"))
    n = F.col("n")
    shown = F.when(n % 7 == 0, "..").when(n % 5 > 0, n.cast("string"))
    cells = rows.groupBy("country", "series", "year").agg(F.count(F.lit(1)).alias("n")).withColumn("shown", shown)
    cell = {name: F.max(F.when(F.col("year") == year, F.col("shown"))).alias(name) for year, name in ORDER_YEARS.items()}
    return cells.groupBy(F.col("country").alias("Country Name"), F.col("series").alias("Series Name")).agg(*cell.values())


def _renames(spark, sf):
    """Every country has an entry; two old names become one."""
    names = read_table(spark, sf, "nation").select(F.col("n_name").alias("old"))
    return names.withColumn("new", map_values(F.col("old"), {**NAMES, "NATION_3": "Second"}))


INDICATORS = f"""
    counted AS (
      SELECT country, year, CAST(substr(commodity, 1, 1) AS INTEGER) AS priority, count(*) AS n FROM ({ORDERS}) GROUP BY ALL),
    pairs AS (SELECT DISTINCT country, priority FROM counted),
    cells AS (
      SELECT p.country AS old, {_case('p.country', {**NAMES, 'NATION_3': 'Second'})} AS country, p.priority, y.column_year AS year,
             CASE WHEN n % 7 = 0 THEN '..' WHEN n % 5 > 0 THEN CAST(n AS VARCHAR) END AS shown
      FROM pairs p CROSS JOIN (VALUES {', '.join(f"({y}, {labels.YEAR_COLUMNS[c]})" for y, c in ORDER_YEARS.items())}) AS y(order_year, column_year)
      LEFT JOIN counted c ON c.country = p.country AND c.priority = p.priority AND c.year = y.order_year)
"""


@query(
    f"""
    WITH {INDICATORS}, countries AS ({COUNTRIES}),
    filled AS (
      SELECT country, priority, year, Region,
             last_value(shown IGNORE NULLS) OVER (PARTITION BY country, priority ORDER BY year, old
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown
      FROM cells JOIN countries ON country = place)
    SELECT Region AS region, year, {q("avg(CASE WHEN shown <> '..' THEN CAST(shown AS DOUBLE) END)")} AS mean_score
    FROM filled WHERE priority > 1 GROUP BY 1, 2
    """
)
def prepared_indicators(spark, sf):
    """Indicators renamed, unfolded, enriched and filled, then means per region and year."""
    prepared = prepare_indicators(_indicators(spark, sf), _renames(spark, sf), _countries(spark, sf))
    means = IndicatorExplorer(prepared).choose().line_means("Region")
    return tidied(means.withColumnsRenamed({"Region": "region", "score_rank": "mean_score"}), ["mean_score"])


@query(
    f"""
    WITH {INDICATORS}, countries AS ({COUNTRIES}), commodities AS ({COMMODITIES}),
    scores AS (
      SELECT country, year, {', '.join(f"max(CASE WHEN priority = {p} AND shown <> '..' THEN CAST(shown AS DOUBLE) END) AS s{p}" for p in (2, 3, 4, 5))}
      FROM (SELECT * FROM cells QUALIFY count(shown) OVER (PARTITION BY old, priority) = 6) WHERE country <> 'Second' GROUP BY 1, 2),
    means AS (
      SELECT country, CAST(year * 2 - 1984 AS INTEGER) AS year, commodity, food_supply_stage, avg(loss_percentage) AS loss
      FROM ({ORDERS}) WHERE food_supply_stage <> 'Farm' GROUP BY ALL),
    joined AS (
      SELECT m.country, m.year, commodity, food_supply_stage, s2, s3, s4, s5, Region, Income
      FROM scores s JOIN means m ON s.country = m.country AND s.year = m.year JOIN countries ON m.country = place
      JOIN commodities ON commodity = Commodities),
    yearly AS (
      SELECT country, year, {', '.join(f"arg_max({c}, commodity || '|' || food_supply_stage) AS {c}" for c in ('s2', 's3', 's4', 's5', 'Region', 'Income', 'commodity', 'food_supply_stage'))}
      FROM joined GROUP BY 1, 2),
    dense AS (
      SELECT span.country, y AS year, yearly.* EXCLUDE (country, year)
      FROM (SELECT country, unnest(generate_series(min(year), max(year))) AS y FROM yearly GROUP BY 1) span
      LEFT JOIN yearly ON yearly.country = span.country AND yearly.year = y),
    filled AS (
      SELECT country, year, {', '.join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ('s2', 's3', 's4', 's5', 'Region', 'Income', 'commodity', 'food_supply_stage'))}
      FROM dense WINDOW w AS (PARTITION BY country ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT f.country, CAST(f.year AS INTEGER) AS year, f.food_supply_stage AS stage, Region AS region, Income AS income, s2, s3, s4, s5, {q('loss')} AS loss
    FROM filled f JOIN means USING (country, year, commodity, food_supply_stage)
    """
)
def built_panel(spark, sf):
    """The panel of the policy ranking: yearly scores beside the measured losses of the same year."""
    scores = {f"s{k}": labels.SCORE_CATEGORIES[PRIORITY_SERIES[k]] for k in (2, 3, 4, 5)}
    # 1996, 1997, ... become 2008, 2010, ...: years with and without scores
    losses = _orders(spark, sf).drop("m49_code").withColumn("year", F.col("year") * 2 - 1984)
    # the ranking wants one row per country and series
    indicators = _indicators(spark, sf).filter("`Country Name` NOT IN ('NATION_2', 'NATION_3')")
    panel = ranking.build_panel(
        ranking.Inputs(losses, indicators, _renames(spark, sf), _countries(spark, sf), _commodities(spark, sf))
    )
    found = panel.select(
        "country",
        "year",
        F.col("food_supply_stage").alias("stage"),
        F.col("Region").alias("region"),
        F.col("Income").alias("income"),
        *[F.col(f"`{name}`").alias(short) for short, name in scores.items()],
        F.col("loss_percentage").alias("loss"),
    )
    return tidied(found, ["loss"])
