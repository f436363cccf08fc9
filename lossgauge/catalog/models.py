"""Queries for fits, comparisons, tests and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lossgauge.catalog.registry import q, query, tidied
from lossgauge.operators import decide, stats
from lossgauge.operators.enrich import attach_dimension
from lossgauge.plans import policy_ranking as plan
from lossgauge.session import stable
from lossgauge.sources.delimited import read_table

FEATURES = ["quantity", "discount", "tax"]
CATEGORIES = {"quantity": "ECONOMY", "discount": "PROMO", "tax": "SMALL"}


def horner(coefficients, x: str) -> str:
    """SQL text of a polynomial, lowest power first."""
    text = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * ({x}) + {c!r}::DOUBLE)"
    return text


def det3(a, b, c, d, e, f, g, h, i) -> str:
    return f"(({a})*(({e})*({i})-({f})*({h})) - ({b})*(({d})*({i})-({f})*({g})) + ({c})*(({d})*({h})-({e})*({g})))"


def ols_sql(table: str, by: str, target: str, features=FEATURES) -> str:
    """CTE body: Cramer's rule on the covariance matrix of three features, one row per group and feature."""
    names = ["u", "v", "w"]
    moments = ", ".join(
        [f"covar_pop({features[i]}, {features[j]}) AS {names[i]}{names[j]}" for i in range(3) for j in range(3)]
        + [f"covar_pop({features[i]}, {target}) AS {names[i]}_target" for i in range(3)]
    )
    cells = [[f"{x}{y}" for y in names] for x in names]
    whole = det3(*[c for row in cells for c in row])
    solved = []
    for k, feature in enumerate(features):
        swapped = [[f"{names[r]}_target" if col == k else cells[r][col] for col in range(3)] for r in range(3)]
        solved.append(
            f"SELECT {by}, n, '{feature}' AS feature, {det3(*[c for row in swapped for c in row])} / {whole} AS coef FROM m"
        )
    return (
        f"WITH m AS (SELECT {by}, count(*) AS n, {moments} FROM {table}\n"
        f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (by, target, *features))} GROUP BY {by})\n"
        + "\nUNION ALL ".join(solved)
    )


LINES = "SELECT l_returnflag, l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_extendedprice AS price FROM lineitem"


def _lines(spark, sf):
    return read_table(spark, sf, "lineitem").select(
        "l_returnflag",
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"),
    )


@query(
    f"WITH lines AS ({LINES}), fits AS ({ols_sql('lines', 'l_returnflag', 'price')})\n"
    f"SELECT l_returnflag, n, feature, {q('coef')} AS coef FROM fits"
)
def ols_by_group(spark, sf):
    fits = stats.fit_least_squares(_lines(spark, sf), by=["l_returnflag"], target="price", features=FEATURES)
    return tidied(stats.coefficient_rows(fits, FEATURES), ["coef"])


@query(
    f"WITH lines AS ({LINES}), fits AS ({ols_sql('lines', 'l_returnflag', 'price')})\n"
    "SELECT feature, "
    + ", ".join(f"""{q(f"max(coef) FILTER (l_returnflag = '{f}')")} AS "{f}" """ for f in "ANR")
    + " FROM fits GROUP BY feature"
)
def coef_matrix(spark, sf):
    fits = stats.fit_least_squares(_lines(spark, sf), by=["l_returnflag"], target="price", features=FEATURES)
    table = stats.coefficient_table(stats.coefficient_rows(fits, FEATURES), "l_returnflag", list("ANR"))
    return tidied(table, list("ANR"))


# price per thousand, and a near copy of it that quantity tells apart by a millionth
NEAR = ["price", "copy", "tax"]


@query(
    f"""WITH lines AS ({LINES}), fits AS ({ols_sql('lines', 'l_returnflag', 'discount', ['price', 'quantity', 'tax'])})
    SELECT l_returnflag, n, 'copy' AS feature, {q("coef * 1e3")} AS coef FROM fits WHERE feature = 'quantity'
    UNION ALL SELECT l_returnflag, n, 'both', {q("coef * 1e3")} FROM fits WHERE feature = 'price'
    UNION ALL SELECT l_returnflag, n, 'tax', {q("coef * 1e3")} FROM fits WHERE feature = 'tax'"""
)
def ols_nearly_dependent(spark, sf):
    """Discount on price, a near copy of the price, and tax; the SQL fits on price and what the copy adds to it.

    Given are the copy's coefficient in the units of quantity, and that of price and copy moving together.
    """
    lines = _lines(spark, sf).withColumn("copy", F.col("price") + F.col("quantity") / 1e6)
    fits = stats.fit_nearly_dependent(lines, by=["l_returnflag"], target="discount", features=NEAR)
    price, copy, tax = (F.col("coefficients")[i] for i in range(3))
    parts = [("copy", copy / 1e6), ("both", price + copy), ("tax", tax)]
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), (value * 1e3).alias("coef")) for name, value in parts])
    return tidied(fits.select("l_returnflag", "n", F.inline(rows)), ["coef"])


# order-level rows: means of the order's lines, price, customer, segment, nation, region
BASKETS = """
    SELECT o_orderkey, o_custkey, c_mktsegment, n_name, r_name, o_orderpriority, o_totalprice AS price,
           avg(l_quantity) AS quantity, avg(l_discount) * 100 AS discount, avg(l_tax) * 100 AS tax
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ALL
"""


def baskets(spark, sf):
    """Written once: several aggregations read these rows."""
    lines = (
        read_table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.avg("l_quantity").alias("quantity"),
            (F.avg("l_discount") * 100).alias("discount"),
            (F.avg("l_tax") * 100).alias("tax"),
        )
    )
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("price")
    )
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = attach_dimension(orders, lines, "o_orderkey", "l_orderkey")
    rows = attach_dimension(rows, customers, "o_custkey", "c_custkey")
    rows = attach_dimension(rows, read_table(spark, sf, "nation"), "c_nationkey", "n_nationkey")
    rows = attach_dimension(rows, read_table(spark, sf, "region"), "n_regionkey", "r_regionkey")
    return stable(rows.drop("c_nationkey", "n_regionkey"))


# Some customers have no complete row, some have few; some nations have none.
GAPPED = """
    SELECT * REPLACE (CASE WHEN n_name IN ('NATION_6', 'NATION_13') OR o_custkey % 7 = 3
                             OR o_custkey % 7 = 5 AND o_orderpriority > '2' THEN NULL ELSE tax END AS tax)
    FROM baskets
"""


def gapped(spark, sf):
    rows = baskets(spark, sf)
    key = F.col("o_custkey") % 7
    gap = F.col("n_name").isin("NATION_6", "NATION_13") | (key == 3) | ((key == 5) & (F.col("o_orderpriority") > "2"))
    return rows.withColumn("tax", F.when(~gap, F.col("tax")))


def nearest_sql(table: str, entity: str, group: str, features=FEATURES) -> str:
    means = ", ".join(f"avg({f}) AS {f}" for f in features)
    gaps = " + ".join(f"coalesce(g.{f} - e.{f}, 0)" for f in features)
    return f"""
    WITH e AS (SELECT {entity}, count(*) AS n, {means} FROM {table} GROUP BY 1),
    g AS (SELECT {group}, {means} FROM {table} GROUP BY 1),
    d AS (SELECT e.{entity}, e.n, g.{group}, abs({gaps}) AS distance FROM e, g),
    best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY {entity} ORDER BY distance, {group}) = 1),
    k AS (SELECT {entity}, {group}, count(*) AS k FROM {table} GROUP BY ALL),
    actual AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY {entity} ORDER BY k DESC, {group}) = 1)
    SELECT {entity}, n, actual.{group} AS actual_group, best.{group} AS nearest_group, distance,
           best.{group} = actual.{group} AS is_equal
    FROM best JOIN actual USING ({entity})
    """


@query(
    f"""
    WITH baskets AS ({BASKETS}),
    gaps AS (SELECT * REPLACE (CASE WHEN o_orderpriority < '3' THEN tax END AS tax) FROM baskets),
    found AS ({nearest_sql('gaps', 'o_custkey', 'o_orderpriority')})
    SELECT * REPLACE ({q('distance', 6)} AS distance) FROM found
    """
)
def nearest_group(spark, sf):
    rows = baskets(spark, sf).withColumn("tax", F.when(F.col("o_orderpriority") < "3", F.col("tax")))
    found = stats.nearest_group(rows, entity="o_custkey", group="o_orderpriority", features=FEATURES)
    return tidied(found, ["distance"], 6)


def welch_sql(table: str, pairs: str, entity: str, group: str, features=FEATURES, exclude_self=False) -> str:
    """CTE body; the p-value integrates the density of Student's t by Simpson's rule."""
    own, other = (
        "\nUNION ALL ".join(
            f"SELECT {by}, '{f}' AS feature, count({f}) AS n, avg({f}) AS m, var_samp({f}) AS v FROM {table} GROUP BY 1"
            for f in features
        )
        for by in (entity, group)
    )
    if exclude_self:
        other = "\nUNION ALL ".join(
            f"SELECT x.{entity}, x.{group}, '{f}' AS feature, count({f}) AS n, avg({f}) AS m, var_samp({f}) AS v FROM ({pairs}) x "
            f"JOIN {table} y ON y.{group} = x.{group} AND y.{entity} <> x.{entity} GROUP BY 1, 2"
            for f in features
        )
    same = f"AND other.{entity} = p.{entity}" if exclude_self else ""
    return f"""
    WITH own AS ({own}), other AS ({other}),
    measured AS (
      SELECT p.{entity}, p.{group}, own.feature, own.n > 1 AND other.n > 1 AS enough,
             own.v / own.n AS a, other.v / other.n AS b, own.m - other.m AS gap, own.n AS n1, other.n AS n2
      FROM ({pairs}) p JOIN own ON own.{entity} = p.{entity} JOIN other ON other.{group} = p.{group} {same} AND other.feature = own.feature),
    tested AS (
      SELECT *, CASE WHEN enough AND a + b > 0 THEN gap / sqrt(a + b) END AS t,
             CASE WHEN enough AND a + b > 0 THEN (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) END AS dof
      FROM measured),
    integrated AS (
      SELECT {entity}, {group}, feature, t, dof, enough, a + b AS error,
             CASE WHEN t IS NOT NULL THEN greatest(0, 1 - 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * abs(t) / 400 / 3
               * sum(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                     * (1 + (abs(t) * i / 400) ** 2 / dof) ** (-(dof + 1) / 2))) END AS pval
      FROM tested, generate_series(0, 400) AS s(i) GROUP BY {entity}, {group}, feature, t, dof, enough, a, b)
    SELECT {entity}, {group}, feature, t AS statistic, dof, pval, pval < 0.05 AS significant,
           CASE WHEN NOT enough THEN 'fewer than 2 values' WHEN error = 0 THEN 'constant values' END AS reason
    FROM integrated
    """


@query(
    f"""
    WITH baskets AS ({BASKETS}),
    tests AS ({welch_sql('baskets', 'SELECT DISTINCT n_name, r_name FROM baskets', 'n_name', 'r_name')})
    SELECT n_name, r_name, feature, {q('statistic', 6)} AS statistic, {q('dof', 4)} AS dof, {q('pval', 6)} AS pval,
           significant, reason FROM tests
    """
)
def welch_by_group(spark, sf):
    rows = baskets(spark, sf)
    tests = stats.welch_tests(
        stats.sample_moments(rows, "n_name", FEATURES),
        stats.sample_moments(rows, "r_name", FEATURES),
        rows.select("n_name", "r_name").distinct(),
        entity="n_name",
        group="r_name",
    )
    return tidied(tidied(tests, ["statistic", "pval"], 6), ["dof"], 4)


@query(
    f"""
    WITH baskets AS ({BASKETS}),
    tests AS ({welch_sql('baskets', 'SELECT DISTINCT n_name, r_name FROM baskets', 'n_name', 'r_name', exclude_self=True)})
    SELECT n_name, r_name, feature, {q('statistic', 6)} AS statistic, {q('dof', 4)} AS dof, {q('pval', 6)} AS pval,
           significant, reason FROM tests
    """
)
def welch_excluding_self(spark, sf):
    """Each nation against the other nations of its region."""
    rows = baskets(spark, sf)
    pairs = rows.select("n_name", "r_name").distinct()
    tests = stats.welch_tests(
        stats.sample_moments(rows, "n_name", FEATURES),
        stats.moments_without(rows, pairs, entity="n_name", group="r_name", features=FEATURES),
        pairs,
        entity="n_name",
        group="r_name",
        exclude_self=True,
    )
    return tidied(tidied(tests, ["statistic", "pval"], 6), ["dof"], 4)


# Fixed values of the checks, kept apart from the library's own: Wichura (1988), algorithm AS 241; lowest power first.
CHECK_CENTRE_TOP = (3.3871328727963665, 133.14166789178438, 1971.5909503065513, 13731.69376550946, 45921.95393154987, 67265.7709270087, 33430.57558358813, 2509.0809287301227)
CHECK_CENTRE_BOTTOM = (1.0, 42.31333070160091, 687.1870074920579, 5394.196021424751, 21213.794301586597, 39307.89580009271, 28729.085735721943, 5226.495278852854)
CHECK_MIDDLE_TOP = (1.4234371107496835, 4.630337846156546, 5.769497221460691, 3.6478483247632045, 1.2704582524523684, 0.2417807251774506, 0.022723844989269184, 0.0007745450142783414)
CHECK_MIDDLE_BOTTOM = (1.0, 2.053191626637759, 1.6763848301838038, 0.6897673349851, 0.14810397642748008, 0.015198666563616457, 0.0005475938084995345, 1.0507500716444169e-09)
CHECK_FAR_TOP = (6.657904643501103, 5.463784911164114, 1.7848265399172913, 0.29656057182850487, 0.026532189526576124, 0.0012426609473880784, 2.7115555687434876e-05, 2.0103343992922881e-07)
CHECK_FAR_BOTTOM = (1.0, 0.599832206555888, 0.1369298809227358, 0.014875361290850615, 0.0007868691311456133, 1.8463183175100548e-05, 1.421511758316446e-07, 2.0442631033899397e-15)
# Royston (1995), algorithm AS R94; lowest power first.
CHECK_WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
CHECK_WEIGHT_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
CHECK_SMALL_GAMMA = (-2.273, 0.459)
CHECK_SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
CHECK_SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
CHECK_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
CHECK_LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)


def quantile_sql(p: str) -> str:
    near = f"(0.180625 - (({p}) - 0.5) ** 2)"
    tail = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    top, bottom = horner(CHECK_CENTRE_TOP, near), horner(CHECK_CENTRE_BOTTOM, near)
    mid = f"{horner(CHECK_MIDDLE_TOP, f'{tail} - 1.6')} / {horner(CHECK_MIDDLE_BOTTOM, f'{tail} - 1.6')}"
    far = f"{horner(CHECK_FAR_TOP, f'{tail} - 5')} / {horner(CHECK_FAR_BOTTOM, f'{tail} - 5')}"
    return (
        f"(CASE WHEN abs(({p}) - 0.5) <= 0.425 THEN (({p}) - 0.5) * {top} / {bottom} "
        f"ELSE sign(({p}) - 0.5) * (CASE WHEN {tail} <= 5 THEN {mid} ELSE {far} END) END)"
    )


def shapiro_sql(table: str, by: str, value: str) -> str:
    """CTE body for samples that are not constant."""
    root = "(1 / sqrt(n))"
    return f"""
    WITH ranked AS (
      SELECT {by}, {value} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS i,
             (count(*) OVER (PARTITION BY {by}))::DOUBLE AS n
      FROM {table} WHERE {value} IS NOT NULL),
    scored AS (SELECT *, {quantile_sql('(i - 0.375) / (n + 0.25)')} AS m FROM ranked),
    sums AS (
      SELECT {by}, n, sum(m * m) AS q, var_pop(x) * n AS ss, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2
      FROM scored GROUP BY {by}, n),
    ends AS (
      SELECT *, {horner(CHECK_WEIGHT_LAST, root)} + m1 / sqrt(q) AS a1, {horner(CHECK_WEIGHT_SECOND, root)} + m2 / sqrt(q) AS a2
      FROM sums),
    weights AS (
      SELECT {by}, n, ss, x,
             CASE WHEN n = 3 THEN (i - 2) * sqrt(0.5)
                  WHEN n <= 5 THEN CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 ELSE m / sqrt((q - 2 * m1 * m1) / (1 - 2 * a1 * a1)) END
                  ELSE CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 WHEN i = 2 THEN -a2
                            ELSE m / sqrt((q - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END END AS a
      FROM scored JOIN ends USING ({by}, n) WHERE n >= 3),
    w AS (SELECT {by}, n, sum(a * x) ** 2 / max(ss) AS w FROM weights GROUP BY {by}, n),
    z AS (
      SELECT *, ln(1 - w) AS miss, {horner(CHECK_SMALL_GAMMA, 'n')} AS gamma,
             CASE WHEN n > 11 THEN (ln(1 - w) - {horner(CHECK_LARGE_MEAN, 'ln(n)')}) / exp({horner(CHECK_LARGE_SPREAD, 'ln(n)')})
                  WHEN n > 3 AND ln(1 - w) < {horner(CHECK_SMALL_GAMMA, 'n')}
                  THEN (-ln({horner(CHECK_SMALL_GAMMA, 'n')} - ln(1 - w)) - {horner(CHECK_SMALL_MEAN, 'n')}) / exp({horner(CHECK_SMALL_SPREAD, 'n')}) END AS z
      FROM w),
    upper AS (
      SELECT {by}, n, w, miss, gamma,
             0.5 - z / 400 / 3 / sqrt(2 * pi()) * sum(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-((z * i / 400) ** 2) / 2)) AS up
      FROM z, generate_series(0, 400) AS s(i) GROUP BY {by}, n, w, miss, gamma, z)
    SELECT {by}, '{value}' AS feature, CAST(n AS BIGINT) AS n, w AS statistic,
           CASE WHEN n = 3 THEN greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))), 0)
                WHEN n <= 11 AND miss >= gamma THEN 0 ELSE up END AS pval,
           CASE WHEN n > 5000 THEN 'p-value may be inaccurate above 5000 values' END AS reason
    FROM upper
    """


@query(
    f"""
    WITH customers AS (SELECT n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
    tests AS ({shapiro_sql('customers', 'n_name', 'c_acctbal')})
    SELECT n_name, feature, n, {q('statistic', 6)} AS statistic, {q('pval', 6)} AS pval, pval >= 0.05 AS normal, reason FROM tests
    UNION ALL SELECT n_name, 'c_acctbal', count(*), NULL, NULL, NULL, 'fewer than 3 values' FROM customers GROUP BY 1 HAVING count(*) < 3
    """
)
def normality_by_group(spark, sf):
    customers = attach_dimension(
        read_table(spark, sf, "customer"), read_table(spark, sf, "nation"), "c_nationkey", "n_nationkey"
    )
    tests = stats.normality_tests(customers, by="n_name", features=["c_acctbal"])
    return tidied(tests, ["statistic", "pval"], 6)


@query(
    f"""
    WITH tests AS ({shapiro_sql('lineitem', 'l_returnflag', 'l_quantity')})
    SELECT l_returnflag, feature, n, {q('statistic', 6)} AS statistic, {q('pval', 6)} AS pval, pval >= 0.05 AS normal, reason FROM tests
    """
)
def normality_with_ties(spark, sf):
    tests = stats.normality_tests(read_table(spark, sf, "lineitem"), by="l_returnflag", features=["l_quantity"])
    return tidied(tests, ["statistic", "pval"], 6)


@query(
    f"""
    WITH suppliers AS (SELECT n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    tests AS ({shapiro_sql('suppliers', 'n_name', 's_acctbal')})
    SELECT n_name, feature, n, {q('statistic', 6)} AS statistic, {q('ln(pval)', 4)} AS log_pval, reason FROM tests
    UNION ALL SELECT n_name, 's_acctbal', count(*), NULL, NULL, 'fewer than 3 values' FROM suppliers GROUP BY 1 HAVING count(*) < 3
    """
)
def normality_small(spark, sf):
    """Few suppliers per nation: the small-sample branches, with p-values on a logarithmic scale."""
    suppliers = attach_dimension(
        read_table(spark, sf, "supplier"), read_table(spark, sf, "nation"), "s_nationkey", "n_nationkey"
    )
    tests = stats.normality_tests(suppliers, by="n_name", features=["s_acctbal"])
    tests = tests.withColumn("log_pval", F.log("pval")).drop("pval", "normal")
    return tidied(tidied(tests, ["statistic"], 6), ["log_pval"], 4)


def _named_shapiro(kind: str, by: str, value: str) -> str:
    return f"SELECT '{kind}' AS kind, {by} AS name, * EXCLUDE ({by}) FROM ({shapiro_sql('baskets', by, value)})"


@query(
    f"""
    WITH baskets AS ({BASKETS}),
    tests AS ({" UNION ALL ".join(_named_shapiro(k, b, v) for k, b in (("entity", "n_name"), ("group", "r_name")) for v in FEATURES[:2])})
    SELECT kind, name, feature, n, {q('statistic', 6)} AS statistic, {q('pval', 6)} AS pval, pval >= 0.05 AS normal, reason FROM tests
    """
)
def ranking_normality(spark, sf):
    columns = plan.Columns(entity="n_name", group="r_name", target="price", features=FEATURES[:2])
    return tidied(plan.normality(baskets(spark, sf), columns), ["statistic", "pval"], 6)


def selection_sql(table: str, entity: str, group: str, few: int) -> str:
    """CTE body: comparison, both series of tests and the choice, for all entities.

    An own fit is weak if there are few rows, no complete row, or one: coefficients of zero sum to zero.
    """
    complete = " AND ".join(f"{f} IS NOT NULL" for f in (*FEATURES, "price"))
    return f"""
    WITH comparison AS ({nearest_sql(table, entity, group)}),
    actual_tests AS ({welch_sql(table, f'SELECT {entity}, actual_group AS {group} FROM comparison', entity, group)}),
    nearest_tests AS ({welch_sql(table, f'SELECT {entity}, nearest_group AS {group} FROM comparison', entity, group)}),
    counts AS (
      SELECT {entity}, a, b FROM (SELECT {entity}, count(*) FILTER (significant) AS a FROM actual_tests GROUP BY 1)
      JOIN (SELECT {entity}, count(*) FILTER (significant) AS b FROM nearest_tests GROUP BY 1) USING ({entity})),
    solved AS (SELECT {entity}, count(*) FILTER ({complete}) AS k FROM {table} GROUP BY 1),
    choice AS (
      SELECT *, n <= {few} OR k <= 1 AS weak,
             CASE WHEN weak AND is_equal THEN 'actual group' WHEN weak AND a >= b THEN 'nearest group' ELSE 'own' END AS chosen
      FROM comparison JOIN counts USING ({entity}) JOIN solved USING ({entity}))
    SELECT {entity}, n, actual_group, nearest_group, chosen,
           CASE chosen WHEN 'actual group' THEN actual_group WHEN 'nearest group' THEN nearest_group END AS model_group
    FROM choice
    """


@query(
    f"WITH baskets AS ({BASKETS}), gaps AS ({GAPPED}) SELECT * FROM ({selection_sql('gaps', 'o_custkey', 'c_mktsegment', 5)})"
)
def select_model(spark, sf):
    rows = gapped(spark, sf)
    return plan.rank_categories(
        rows, plan.Columns(entity="o_custkey", group="c_mktsegment", target="price", features=FEATURES)
    ).selection


NATION_FEW = 600


def ranked_sql(few: int) -> str:
    return f"""
    gaps AS ({GAPPED}), own AS ({ols_sql('gaps', 'n_name', 'price')}), lent AS ({ols_sql('gaps', 'r_name', 'price')}),
    selection AS ({selection_sql('gaps', 'n_name', 'r_name', few)}),
    chosen AS (
      SELECT s.n_name, own.feature, own.coef FROM selection s JOIN own ON own.n_name = s.n_name WHERE chosen = 'own'
      UNION ALL SELECT s.n_name, lent.feature, lent.coef FROM selection s JOIN lent ON lent.r_name = s.model_group),
    priorities AS (
      SELECT n_name, feature, coef, CAST(row_number() OVER (PARTITION BY n_name ORDER BY coef DESC, feature) AS INTEGER) AS weight,
             CAST(row_number() OVER (PARTITION BY n_name ORDER BY coef, feature DESC) AS INTEGER) AS priority
      FROM chosen WHERE coef < 0)
    """


def _nation_ranking(spark, sf):
    return plan.rank_categories(
        gapped(spark, sf),
        plan.Columns(entity="n_name", group="r_name", target="price", features=FEATURES),
        few=NATION_FEW,
    )


@query(
    f"WITH baskets AS ({BASKETS}), {ranked_sql(NATION_FEW)} SELECT n_name, feature, {q('coef')} AS coef, weight, priority FROM priorities"
)
def priority_rank(spark, sf):
    return tidied(_nation_ranking(spark, sf).priorities, ["coef"])


SHELF = """
    SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS position
    FROM part
"""
# some loadings are unknown: those items come last
GAPPED_SHELF = """
    SELECT p_type, p_partkey, CASE WHEN p_partkey % 11 > 0 THEN part.p_retailprice END AS p_retailprice,
           row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN p_partkey % 11 > 0 THEN part.p_retailprice END DESC NULLS LAST, p_partkey) AS position
    FROM part
"""


@query(
    f"""
    WITH lines AS ({LINES}), fits AS ({ols_sql('lines', 'l_returnflag', 'price')}),
    priorities AS (
      SELECT l_returnflag, CASE feature WHEN 'quantity' THEN 'ECONOMY' WHEN 'discount' THEN 'PROMO' ELSE 'SMALL' END AS p_type,
             CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY coef, feature DESC) AS INTEGER) AS priority
      FROM fits WHERE coef < 0)
    SELECT l_returnflag, p_type, priority, p_partkey, p_retailprice, position,
           CASE priority WHEN 1 THEN '1st' WHEN 2 THEN '2nd' ELSE '3rd' END AS label
    FROM priorities JOIN ({GAPPED_SHELF}) USING (p_type)
    """
)
def catalogue_ranked(spark, sf):
    return _flag_policies(spark, sf, F.when(F.col("p_partkey") % 11 > 0, F.col("p_retailprice")).alias("p_retailprice"))


@query(
    f"""
    WITH lines AS ({LINES}), fits AS ({ols_sql('lines', 'l_returnflag', 'price')}),
    priorities AS (
      SELECT l_returnflag, CASE feature WHEN 'quantity' THEN 'ECONOMY' WHEN 'discount' THEN 'PROMO' ELSE 'SMALL' END AS p_type,
             CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY coef, feature DESC) AS INTEGER) AS priority
      FROM fits WHERE coef < 0)
    SELECT l_returnflag, p_type, priority, p_partkey, p_brand AS benefits, p_name AS risks, position,
           CASE priority WHEN 1 THEN '1st' WHEN 2 THEN '2nd' ELSE '3rd' END AS label
    FROM priorities JOIN ({SHELF}) USING (p_type) JOIN part USING (p_type, p_partkey)
    WHERE p_partkey % 3 > 0 AND p_size > 10
    """
)
def catalogue_detailed(spark, sf):
    """The second list: positions count all items, rows are those with both texts known."""
    benefits = F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("benefits")
    risks = F.when(F.col("p_size") > 10, F.col("p_name")).alias("risks")
    listed = _flag_policies(spark, sf, "p_retailprice", benefits, risks, details=["benefits", "risks"])
    return listed.drop("p_retailprice")


def _flag_policies(spark, sf, *columns, details=()):
    fits = stats.fit_least_squares(_lines(spark, sf), by=["l_returnflag"], target="price", features=FEATURES)
    priorities = decide.rank_priorities(stats.coefficient_rows(fits, FEATURES), entity="l_returnflag")
    short = priorities.replace(CATEGORIES, subset=["feature"])
    catalogue = read_table(spark, sf, "part").select("p_type", "p_partkey", *columns)
    return plan.list_policies(
        short, catalogue, entity="l_returnflag", category="p_type", item="p_partkey", loading="p_retailprice", details=details
    )


@query(
    f"""
    WITH baskets AS ({BASKETS}), {ranked_sql(NATION_FEW)},
    shelf AS ({SHELF})
    SELECT n_name, p.priority, c.p_type, count(*) AS items,
           CASE p.priority WHEN 1 THEN '1st' WHEN 2 THEN '2nd' ELSE '3rd' END AS label
    FROM priorities p
    JOIN (VALUES ('quantity', 'ECONOMY'), ('discount', 'PROMO'), ('tax', 'SMALL')) AS c(feature, p_type) ON c.feature = p.feature
    JOIN shelf s ON s.p_type = c.p_type GROUP BY ALL
    """
)
def policy_ranking(spark, sf):
    """The compact list of all nations."""
    short = _nation_ranking(spark, sf).priorities.replace(CATEGORIES, subset=["feature"])
    shelf = read_table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")
    ranked = decide.rank_catalogue(shelf, category="p_type", item="p_partkey", loading="p_retailprice")
    return decide.compact_list(short, ranked, entity="n_name", category="p_type")


CHOSEN = ["NATION_1", "NATION_6", "NATION_13"]


@query(
    f"""
    WITH baskets AS ({BASKETS}), {ranked_sql(NATION_FEW)},
    shelf AS ({SHELF})
    SELECT n_name, p.priority, c.p_type, p_partkey, position
    FROM priorities p
    JOIN (VALUES ('quantity', 'ECONOMY'), ('discount', 'PROMO'), ('tax', 'SMALL')) AS c(feature, p_type) ON c.feature = p.feature
    JOIN shelf s ON s.p_type = c.p_type
    WHERE n_name IN ('NATION_1', 'NATION_6', 'NATION_13')
    """
)
def policy_listing(spark, sf):
    """The full list of the nations that are shown."""
    short = _nation_ranking(spark, sf).priorities.replace(CATEGORIES, subset=["feature"])
    shelf = read_table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")
    listed = plan.list_policies(
        short, shelf, entity="n_name", category="p_type", item="p_partkey", loading="p_retailprice", entities=CHOSEN
    )
    return listed.select("n_name", "priority", "p_type", "p_partkey", "position")


CORRELATIONS = """
    SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_discount) AS a, corr(l_quantity, l_extendedprice) AS b,
           corr(l_discount, l_extendedprice) AS c
    FROM lineitem GROUP BY 1
"""
ITEMS = ["l_quantity", "l_discount", "l_extendedprice"]


@query(
    f"""
    WITH r AS ({CORRELATIONS}),
    s AS (SELECT l_returnflag, n, -ln(1 + 2 * a * b * c - a * a - b * b - c * c) * (n - 1 - 11 / 6::DOUBLE) AS x FROM r),
    p AS (
      SELECT l_returnflag, n, x, 1 - 2 * sqrt(x) / 400 / 3 / sqrt(2 * pi())
               * sum(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-((sqrt(x) * i / 400) ** 2) / 2))
               + sqrt(2 * x / pi()) * exp(-x / 2) AS pval
      FROM s, generate_series(0, 400) AS t(i) GROUP BY l_returnflag, n, x)
    SELECT l_returnflag, n, {q('x', 6)} AS statistic, 3 AS dof, {q('pval', 6)} AS pval FROM p
    """
)
def bartlett_kmo(spark, sf):
    found = stats.bartlett_sphericity(read_table(spark, sf, "lineitem"), by=["l_returnflag"], items=ITEMS)
    return tidied(found, ["statistic", "pval"], 6)


@query(
    f"""
    WITH r AS ({CORRELATIONS}),
    p AS (
      SELECT l_returnflag, a * a AS a2, b * b AS b2, c * c AS c2,
             (a - b * c) ** 2 / ((1 - b * b) * (1 - c * c)) AS pa, (b - a * c) ** 2 / ((1 - a * a) * (1 - c * c)) AS pb,
             (c - a * b) ** 2 / ((1 - a * a) * (1 - b * b)) AS pc
      FROM r)
    SELECT l_returnflag, 'l_quantity' AS item, {q('(a2 + b2) / (a2 + b2 + pa + pb)', 6)} AS kmo FROM p
    UNION ALL SELECT l_returnflag, 'l_discount', {q('(a2 + c2) / (a2 + c2 + pa + pc)', 6)} FROM p
    UNION ALL SELECT l_returnflag, 'l_extendedprice', {q('(b2 + c2) / (b2 + c2 + pb + pc)', 6)} FROM p
    UNION ALL SELECT l_returnflag, 'overall', {q('(a2 + b2 + c2) / (a2 + b2 + c2 + pa + pb + pc)', 6)} FROM p
    """
)
def bartlett_kmo_adequacy(spark, sf):
    found = stats.sampling_adequacy(read_table(spark, sf, "lineitem"), by=["l_returnflag"], items=ITEMS)
    return tidied(found, ["kmo"], 6)
