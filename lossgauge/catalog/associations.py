"""Queries for association of columns, missing values and text columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from lossgauge.catalog.registry import q, query, tidied
from lossgauge.operators import association, missing, sketches, texts
from lossgauge.session import stable
from lossgauge.sources.delimited import read_table

# lines whose discount or tax of zero stands for "none given"
LINES = """(SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
                   nullif(l_returnflag, 'N') AS l_returnflag FROM lineitem)"""
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    none = {c: F.nullif(F.col(c), F.lit(0.0)) for c in ("l_discount", "l_tax")}
    return lines.withColumns({**none, "l_returnflag": F.nullif("l_returnflag", F.lit("N"))})


def _ranked(a: str, b: str) -> str:
    return f"""
        SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
               rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
        FROM {LINES} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""


@query(
    "\nUNION ALL ".join(
        [
            f"SELECT '{x}' AS a, '{y}' AS b, {q('corr(ra, rb)', 6)} AS corr FROM ({_ranked(a, b)})"
            for a, b in combinations(LINE_NUMBERS, 2)
            for x, y in ((a, b), (b, a))
        ]
        + [f"SELECT '{c}' AS a, '{c}' AS b, 1.0::DOUBLE AS corr" for c in LINE_NUMBERS]
    )
)
def profile_rank_corr(spark, sf):
    """Spearman's correlation of the line numbers, over the lines where both are given."""
    return tidied(association.rank_correlations(_lines(spark, sf), LINE_NUMBERS), ["corr"], 6)


CUSTOMERS = """(SELECT c_acctbal, c_nationkey, n_orders, highest FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS highest FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
CUSTOMER_NUMBERS = ["c_acctbal", "c_nationkey", "n_orders", "highest"]


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, (SELECT count(*) FROM {CUSTOMERS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n,
        {q("sum(sign(s.x - t.x) * sign(s.y - t.y)) / sqrt(sum(abs(sign(s.x - t.x)))) / sqrt(sum(abs(sign(s.y - t.y))))", 6)} AS tau
        FROM (SELECT {a} AS x, {b} AS y FROM {CUSTOMERS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS s,
             (SELECT {a} AS x, {b} AS y FROM {CUSTOMERS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS t"""
        for a, b in combinations(CUSTOMER_NUMBERS, 2)
    )
)
def profile_kendall(spark, sf):
    """Kendall's tau-b of balance, nation number, number of orders and highest price of the customers."""
    orders = read_table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("highest")
    )
    customers = read_table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return tidied(association.kendall_correlations(customers, CUSTOMER_NUMBERS), ["tau"], 6)


ORDERS = """(SELECT nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS year,
             CAST(o_custkey AS VARCHAR) AS customer, 'order' AS kind FROM orders)"""
ORDER_TEXTS = ["status", "priority", "year", "customer", "kind"]


def _cramer_sql(a: str, b: str) -> str:
    return f"""
    SELECT '{a}' AS a, '{b}' AS b, CAST(n AS BIGINT) AS n, values_a, values_b,
           CASE WHEN values_a > 1 AND values_b > 1 THEN {q("n * greatest(s - 1, 0)", 3)} END AS chi2,
           CASE WHEN values_a > 1 AND values_b > 1 THEN {q('''sqrt(greatest(greatest(s - 1, 0) - (values_a - 1) * (values_b - 1) / (n - 1.0), 0)
               / (least(values_a - (values_a - 1) ** 2 / (n - 1.0), values_b - (values_b - 1) ** 2 / (n - 1.0)) - 1))''', 6)} END AS v,
           CASE WHEN n = 0 THEN 'no rows' WHEN values_a < 2 OR values_b < 2 THEN 'constant column' END AS reason
    FROM (SELECT sum(k) AS n, sum(k * k / CAST(kx AS DOUBLE) / ky) AS s, count(DISTINCT x) AS values_a, count(DISTINCT y) AS values_b
          FROM (SELECT x, y, k, sum(k) OVER (PARTITION BY x) AS kx, sum(k) OVER (PARTITION BY y) AS ky
                FROM (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS k FROM {ORDERS}
                      WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)))"""


@query("\nUNION ALL ".join(_cramer_sql(a, b) for a, b in combinations(ORDER_TEXTS, 2)))
def profile_cramers_v(spark, sf):
    """Cramér's V of the text columns of the orders, one of very many values and one constant."""
    orders = read_table(spark, sf, "orders").select(
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.lit("order").alias("kind"),
    )
    found = association.text_association(orders, ORDER_TEXTS)
    return tidied(tidied(found, ["chi2"], 3), ["v"], 6)


GAPS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
MARKS = {c: f"CAST({c} IS NULL AS INTEGER)" for c in GAPS}


@query(f"""
    WITH m AS (SELECT concat({', '.join(MARKS.values())}) AS pattern, {' + '.join(MARKS.values())} AS k FROM {LINES})
    SELECT pattern, CAST(k AS INTEGER) AS n_missing, count(*) AS n, {q('count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM m)', 6)} AS share
    FROM m GROUP BY 1, 2
""")
def profile_missing_patterns(spark, sf):
    return tidied(missing.missing_patterns(_lines(spark, sf), GAPS), ["share"], 6)


@query(
    "\nUNION ALL ".join(
        f"SELECT '{x}' AS a, '{y}' AS b, CASE WHEN var_pop({MARKS[x]}) > 0 AND var_pop({MARKS[y]}) > 0 "
        f"THEN {q(f'corr({MARKS[x]}, {MARKS[y]})', 6)} END AS corr FROM {LINES}"
        for a, b in combinations(GAPS, 2)
        for x, y in ((a, b), (b, a))
    )
)
def profile_missing_corr(spark, sf):
    return tidied(missing.missing_correlation(_lines(spark, sf), GAPS), ["corr"], 6)


def _cluster_sql() -> str:
    """Merges by a recursive query: every column carries the number of its group, which is its first column."""
    far = "\n        UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, sqrt(CAST(count(*) FILTER ({MARKS[a]} <> {MARKS[b]}) AS DOUBLE)) AS d FROM {LINES}"
        for i, a in enumerate(GAPS)
        for j, b in enumerate(GAPS)
        if i != j
    )
    names = "[" + ", ".join(f"'{c}'" for c in GAPS) + "]"
    return f"""
    WITH RECURSIVE far AS ({far}),
    s AS (
        SELECT 0 AS step, i, i AS grp, CAST(-1 AS BIGINT) AS g, CAST(-1 AS BIGINT) AS h, CAST(0 AS DOUBLE) AS distance
        FROM range({len(GAPS)}) AS r(i)
        UNION ALL
        (WITH best AS (
            SELECT x.grp AS g, y.grp AS h, avg(d) AS distance FROM s AS x, s AS y, far
            WHERE x.grp < y.grp AND far.i = x.i AND far.j = y.i GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 1)
        SELECT step + 1, i, CASE WHEN grp = best.h THEN best.g ELSE grp END, best.g, best.h, best.distance FROM s, best)
    )
    SELECT a.step, string_agg({names}[a.i + 1], ',' ORDER BY a.i) FILTER (b.grp = a.g) AS "first",
           string_agg({names}[a.i + 1], ',' ORDER BY a.i) FILTER (b.grp = a.h) AS "second", {q("any_value(a.distance)")} AS distance
    FROM s AS a JOIN s AS b ON a.step = b.step + 1 AND a.i = b.i GROUP BY 1"""


@query(_cluster_sql())
def profile_missing_clusters(spark, sf):
    """Columns of the lines that lack values together, merged step by step."""
    found = missing.missing_clusters(_lines(spark, sf), GAPS)
    joined = {c: F.array_join(c, ",") for c in ("first", "second")}
    return tidied(found.withColumns(joined), ["distance"])


@query(r"""
    WITH c AS (
        SELECT 'text' AS "column", unnest(string_split(text, '')) AS character FROM documents
        UNION ALL SELECT 'source', unnest(string_split(source, '')) FROM documents
    ), k AS (SELECT "column", character, count(*) AS n FROM c WHERE character <> '' GROUP BY 1, 2)
    SELECT "column", character, n, %s AS category, %s AS script FROM k
""" % tuple(
    "CASE " + " ".join(f"WHEN regexp_matches(character, '\\p{{{name}}}') THEN '{name}'" for name in names) + " ELSE 'other' END"
    for names in (texts.CATEGORIES, texts.SCRIPTS)
))
def profile_characters(spark, sf):
    return texts.character_counts(read_table(spark, sf, "documents"), ["text", "source"])


@query(r"""
    WITH c AS (SELECT unnest(string_split(text, '')) AS character FROM documents),
    k AS (SELECT character, count(*) AS n FROM c WHERE character <> '' GROUP BY 1),
    s AS (SELECT %s AS script, count(*) AS characters, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1)
    SELECT 'text' AS "column", script, characters, n, %s AS share FROM s
""" % (
    "CASE " + " ".join(f"WHEN regexp_matches(character, '\\p{{{name}}}') THEN '{name}'" for name in texts.SCRIPTS) + " ELSE 'other' END",
    q("n / CAST(sum(n) OVER () AS DOUBLE)", 6),
))
def profile_scripts(spark, sf):
    return tidied(texts.script_counts(read_table(spark, sf, "documents"), ["text"]), ["share"], 6)


@query(r"""
    WITH t AS (SELECT 'text' AS "column", text AS t FROM documents UNION ALL SELECT 'lang', lang FROM documents),
    m AS (SELECT "column", length(t) AS length, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words FROM t WHERE t IS NOT NULL)
    SELECT "column", CASE WHEN length > 0 THEN CAST(2 ** (length(bin(length)) - 1) AS BIGINT) ELSE 0 END AS at_least,
           count(*) AS n, CAST(sum(length) AS BIGINT) AS characters, CAST(sum(words) AS BIGINT) AS words
    FROM m GROUP BY 1, 2
""")
def profile_text_lengths(spark, sf):
    return texts.length_histogram(read_table(spark, sf, "documents"), ["text", "lang"])


STATE_COLUMNS = ["o_totalprice", "o_custkey", "o_orderpriority", "note"]


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS "rows", count({c}) AS n, count(*) - count({c}) AS missing,
        {"CAST(min(%s) AS DOUBLE)" % c if number else "NULL"} AS lowest, {"CAST(max(%s) AS DOUBLE)" % c if number else "NULL"} AS highest,
        {q(f"avg({c})", 3) if number else "NULL"} AS mean, {q(f"stddev_samp({c})", 3) if number else "NULL"} AS deviation,
        true AS distinct_within, true AS quantiles_within, true AS frequent_within
        FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE repeat(o_orderstatus, 70) END AS note FROM orders)"""
        for c, number in zip(STATE_COLUMNS, (True, True, False, False))
    )
)
def profile_from_states(spark, sf):
    """The profile of the orders from stored states of their years, and whether its sketches keep their promises."""
    orders = read_table(spark, sf, "orders")
    note = F.when(F.col("o_orderstatus") != "P", F.repeat("o_orderstatus", F.lit(70)))
    orders = orders.withColumns({"note": note, "year": F.year("o_orderdate")})
    states = stable(sketches.profile_states(orders, STATE_COLUMNS, by=["year"]))
    found = stable(sketches.profile_of_states(sketches.merge_states(states)))
    errors = sketches.measured_errors(orders, found)
    promised = {
        "distinct": sketches.DISTINCT_ERROR,
        "quantile": sketches.QUANTILE_ERROR,
        "frequent": sketches.FREQUENT_ERROR,
    }
    within = [(F.col(f"{name}_error") <= limit).alias(f"{name.replace('tile', 'tiles')}_within") for name, limit in promised.items()]
    exact = ["column", "rows", "n", "missing", "lowest", "highest", "mean", "deviation"]
    return tidied(found.join(errors, "column").select(*exact, *within), ["mean", "deviation"], 3)
