"""Queries for the table profile."""

from __future__ import annotations

from lossgauge.catalog.registry import q, query, tidied
from lossgauge.operators import profile
from lossgauge.sources.delimited import read_table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(template: str, columns) -> str:
    return "\nUNION ALL ".join(template.format(c=c) for c in columns)


NUMERIC_SQL = (
    "SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, count(*) FILTER ({c} = 0) AS zeros, "
    "count(*) FILTER ({c} < 0) AS negatives, min({c}) AS lowest, max({c}) AS highest, "
    + q("sum({c})", 2)
    + " AS total, "
    + q("avg({c})", 6)
    + " AS mean, "
    + q("stddev_samp({c})", 6)
    + " AS deviation, "
    + q("max({c}) - min({c})")
    + " AS spread, "
    + q("stddev_samp({c}) / avg({c})", 6)
    + " AS variation, "
    + q("skewness({c})")
    + " AS skewness, "
    + q("kurtosis({c})")
    + " AS kurtosis, "
    + ", ".join(q("quantile_cont({c}, %s)" % p) + f" AS {name}" for name, p in profile.QUANTILES.items())
    + ", "
    + q("quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")
    + " AS quartile_range FROM lineitem"
)


@query(_union(NUMERIC_SQL, NUMERIC))
def profile_numeric(spark, sf):
    found = profile.profile_numeric(read_table(spark, sf, "lineitem"), NUMERIC)
    found = tidied(found, ["mean", "deviation", "variation"], 6)
    found = tidied(found, ["spread", "skewness", "kurtosis", *profile.QUANTILES, "quartile_range"])
    return tidied(found, ["total"], 2)


COLUMN_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, CAST(sum(k) AS BIGINT) AS n, CAST(coalesce(sum(k) FILTER ({c} IS NULL), 0) AS BIGINT) AS missing,
        count({c}) AS distinct_values, count(*) FILTER (k = 1 AND {c} IS NOT NULL) AS unique_values
        FROM (SELECT {c}, count(*) AS k FROM orders GROUP BY 1)"""
        for c, t in COLUMN_TYPES.items()
    )
)
def profile_columns(spark, sf):
    return profile.profile_columns(read_table(spark, sf, "orders"))


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, n, CAST(rn AS INTEGER) AS position FROM (
          SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rn FROM documents GROUP BY {c})
        WHERE rn <= 10"""
        for c in ["lang", "source", "n_chars"]
    )
)
def profile_topk(spark, sf):
    return profile.profile_frequent(read_table(spark, sf, "documents"), ["lang", "source", "n_chars"])


@query(
    _union(
        """SELECT '{c}' AS "column", CAST(least(floor(({c} - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n
        FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY ALL""",
        NUMERIC,
    )
)
def profile_histogram(spark, sf):
    return profile.profile_histogram(read_table(spark, sf, "lineitem"), NUMERIC)


@query(
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {q(f'corr({a}, {b})', 6)} AS corr FROM lineitem" for a in NUMERIC for b in NUMERIC
    )
)
def profile_corr(spark, sf):
    return tidied(profile.profile_correlation(read_table(spark, sf, "lineitem"), NUMERIC), ["corr"], 6)


@query(
    f"""
    WITH c AS (SELECT text, lang, source, n_chars, count(*) AS k FROM documents GROUP BY ALL)
    SELECT CAST(sum(k) AS BIGINT) AS n, CAST(sum(k - 1) AS BIGINT) AS duplicates, {q('sum(k - 1) / sum(k)', 8)} AS share FROM c
    """
)
def profile_duplicates(spark, sf):
    documents = read_table(spark, sf, "documents").select("text", "lang", "source", "n_chars")
    return tidied(profile.profile_duplicates(documents), ["share"], 8)


@query("SELECT text, lang, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def profile_duplicate_rows(spark, sf):
    return profile.duplicate_rows(read_table(spark, sf, "documents").select("text", "lang"))
