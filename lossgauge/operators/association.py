"""Association of columns beyond the linear: rank correlation, Kendall's tau-b, Cramér's V.

All column pairs are worked on together, each over the rows where both columns are known. Copies collapse to counts
before the shuffle, sorted work goes by range blocks, and no pair of rows is ever formed.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from lossgauge.operators.ordered import BLOCK, GROUP_LIMIT, into_blocks, running_totals
from lossgauge.operators.profile import short_value
from lossgauge.operators.stats import pair_correlation
from lossgauge.operators.summarize import numeric_columns
from lossgauge.session import stable

# tasks get these helpers by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# cells of one block, which one task holds in Python with its sort order and running weights, some 200 bytes a cell
CELL_LIMIT = 1 << 17


def _numbers(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns as doubles; NaN counts as unknown."""
    kinds = {f.name: f.dataType for f in df.schema}
    known = {c: F.col(c).cast("double") for c in columns}
    return [
        (F.when(~F.isnan(x), x) if isinstance(kinds[c], (DoubleType, FloatType)) else x).alias(c) for c, x in known.items()
    ]


# ---- rank correlation ----------------------------------------------------------------------------


def _rankings(rows: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], tuple[str, str]]:
    """For each ordered pair (a, b) the ranking of a that it needs: (a, c) ranks a among the rows where c is known.

    Columns that are known in the same rows share a ranking, and b changes nothing if it is known wherever a is: a table
    without gaps has one ranking per column. One row of flags reaches the driver.
    """
    pairs = list(permutations(columns, 2))
    lacks = rows.agg(
        *[F.coalesce(F.bool_or(F.col(a).isNotNull() & F.col(b).isNull()), F.lit(False)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    ).first()
    gap = {pair: lacks[i] for i, pair in enumerate(pairs)}

    def stand_in(b: str) -> str:
        return next(c for c in columns if c == b or not gap[b, c] and not gap[c, b])

    return {(a, b): (a, stand_in(b)) if gap[a, b] else (a, a) for a, b in pairs} | {(c, c): (c, c) for c in columns}


def _ranks_of_values(
    rows: DataFrame, columns: Sequence[str], number: dict[tuple[str, str], int], group_limit: int
) -> list[tuple[str, DataFrame]]:
    """For each column, those of fewest values first, a stored table of its values with their ranks ``_r<number>``.

    A value is counted once for all rankings of its column. One number for each column reaches the driver.
    """
    of = {c: sorted((i, known) for (a, known), i in number.items() if a == c) for c in columns}
    most = max(map(len, of.values()))
    entries = []
    for place, c in enumerate(columns):
        known = [F.col(other).isNotNull() for _, other in of[c]] + [F.lit(False)] * (most - len(of[c]))
        flags = [k.alias(f"_k{j}") for j, k in enumerate(known)]
        entries.append(F.struct(F.lit(place).alias("_column"), F.col(c).alias("_value"), *flags))
    long = rows.select(F.inline(F.array(*entries))).filter(F.col("_value").isNotNull())
    counted = long.groupBy("_column", "_value").agg(*[F.count_if(f"_k{j}").alias(f"_n{j}") for j in range(most)])
    counted = stable(counted)
    sizes = {r["_column"]: r["count"] for r in counted.groupBy("_column").count().collect()}
    found = []
    for place in sorted(range(len(columns)), key=lambda i: sizes.get(i, 0)):
        c, size = columns[place], sizes.get(place, 0)
        running = running_totals(
            counted.filter(F.col("_column") == place),
            partition_by=["_column"],
            order_by=["_value"],
            totals={f"_upto{j}": f"_n{j}" for j in range(len(of[c]))},
            blocks=1 if size <= group_limit else -(-size // group_limit),
        )
        # a value that no row of a ranking has gets a number there that no row looks up together with the other column
        ranks = [(F.col(f"_upto{j}") - (F.col(f"_n{j}") - 1) / 2).alias(f"_r{i}") for j, (i, _) in enumerate(of[c])]
        found.append((c, stable(running.select(F.col("_value").alias(c), *ranks))))
    return found


def rank_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """(a, b, corr): Spearman's correlation of all pairs of numeric columns, both ways, and 1 for a column with itself.

    Equal values share the mean of their ranks. Ranks of a pair are taken among the rows where both values are known. A
    column without at least two different values there gives NULL. A rank depends on the value alone: each column's
    values are ranked once and joined to the rows, which are never taken apart and put together again.
    """
    columns = list(columns) if columns else numeric_columns(df)
    rows = stable(df.select(*_numbers(df, columns)))
    needed = _rankings(rows, columns)
    number = {ranking: i for i, ranking in enumerate(sorted(set(needed.values())))}
    ranks = _ranks_of_values(rows, columns, number, group_limit)
    # rows are ranked in place, the columns of few values first. Stored before the last, so that this join and the ones
    # before it can each be split at a frequent value
    for i, (c, ranks_of_c) in enumerate(ranks):
        if i and i == len(ranks) - 1:
            rows = stable(rows)
        rows = rows.join(ranks_of_c, c, "left").drop(c)
    wide = rows
    name = {pair: f"_r{number[ranking]}" for pair, ranking in needed.items()}
    pairs = list(combinations(columns, 2))
    found = wide.agg(
        *[pair_correlation(name[a, b], name[b, a]).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)],
        *[F.when(F.var_pop(name[c, c]) > 0, F.lit(1.0)).alias(f"_d{i}") for i, c in enumerate(columns)],
    )
    cells = [(a, b, f"_p{i}") for i, (a, b) in enumerate(pairs)]
    cells += [(b, a, cell) for a, b, cell in cells] + [(c, c, f"_d{i}") for i, c in enumerate(columns)]
    return found.select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(c).alias("corr")) for a, b, c in cells]))
    )


# ---- Kendall's tau -------------------------------------------------------------------------------


def weighted_inversions(rank: np.ndarray, weight: np.ndarray, label: np.ndarray | None = None) -> float:
    """The sum of weight products over the pairs i < j with rank[i] > rank[j], of one label if labels are given.

    Ranks are distinct. One pass per bit of the rank, from the highest: a pair is counted at the bit where its ranks
    part, by a running weight of ones before zeros among the rows that agree in the higher bits.
    """
    if len(rank) < 2:
        return 0.0
    bits = int(rank.max()).bit_length()
    if label is not None:
        rank = rank + (np.unique(label, return_inverse=True)[1].astype(np.int64) << bits)
        order = np.argsort(rank >> bits, kind="stable")
        rank, weight = rank[order], weight[order]
    total = 0.0
    for bit in range(bits - 1, -1, -1):
        one = (rank >> bit) & 1 == 1
        before = np.cumsum(np.where(one, weight, 0.0))
        prefix = rank >> (bit + 1)
        starts = np.flatnonzero(np.diff(prefix, prepend=prefix[0] - 1))
        base = np.repeat(np.where(starts > 0, before[starts - 1], 0.0), np.diff(np.append(starts, len(rank))))
        total += float(np.sum(np.where(one, 0.0, weight * (before - base))))
        order = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[order], weight[order]
    return total


def _rank_by_y(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The cells in order of (x, y), and the place of each in the order of (y, x)."""
    part = part.sort_values(["x", "y"], kind="stable")
    order = np.lexsort((part["x"].to_numpy(), part["y"].to_numpy()))
    rank = np.empty(len(part), np.int64)
    rank[order] = np.arange(len(part))
    return part, rank


def _inside(part: pd.DataFrame) -> pd.DataFrame:
    cells, rank = _rank_by_y(part)
    return pd.DataFrame({"pair": [int(part["pair"].iat[0])], "inversions": [weighted_inversions(rank, cells["w"].to_numpy())]})


def _across(part: pd.DataFrame) -> pd.DataFrame:
    cells, rank = _rank_by_y(part)
    weight = cells["w"].to_numpy()
    apart = weighted_inversions(rank, weight) - weighted_inversions(rank, weight, cells["x_block"].to_numpy())
    return pd.DataFrame({"pair": [int(part["pair"].iat[0])], "inversions": [apart]})


def _between(cells: DataFrame) -> DataFrame:
    """Inversions of cells that differ in both blocks, from the weights of the block pairs.

    The grid of blocks is filled up so that running sums exist everywhere. It has fewer cells than the table has rows as
    long as there are fewer blocks than cells in a block.
    """
    grid = cells.groupBy("pair", "x_block", "y_block").agg(F.sum("w").alias("w"))
    ends = grid.groupBy("pair").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x_block", "y_block") for f in (F.min, F.max)])
    every = ends.withColumn("x_block", F.explode(F.sequence("min_x_block", "max_x_block"))).withColumn(
        "y_block", F.explode(F.sequence("min_y_block", "max_y_block"))
    )
    keys = ["pair", "x_block", "y_block"]
    full = every.select(*keys).join(grid, keys, "left").fillna(0.0, ["w"])
    so_far = (Window.unboundedPreceding, -1)
    left = Window.partitionBy("pair", "y_block").orderBy("x_block").rowsBetween(*so_far)
    higher = Window.partitionBy("pair", "x_block").orderBy(F.desc("y_block")).rowsBetween(*so_far)
    counted = full.withColumn("left", F.sum("w").over(left)).withColumn("left_higher", F.sum("left").over(higher))
    return counted.groupBy("pair").agg(F.coalesce(F.sum(F.col("w") * F.col("left_higher")), F.lit(0.0)).alias("inversions"))


def kendall_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, cell_limit: int = CELL_LIMIT
) -> DataFrame:
    """(a, b, n, tau): Kendall's tau-b of all pairs of numeric columns, over the n rows where both are known.

    Equal pairs of values collapse to cells with a count. A pair of cells is discordant if its order by (x, y) and its
    order by (y, x) disagree, so ties are never counted. Cells are cut into range blocks by both orders: inversions are
    counted within the blocks of the first, within the blocks of the second between different blocks of the first, and
    for all others from the weights of block pairs. A constant column gives NULL. Pair counts are doubles: exact up to
    about 10^8 rows, else to 15 digits.
    """
    columns = list(columns) if columns else numeric_columns(df)
    pairs = list(combinations(columns, 2))
    named = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    numbers = df.select(*_numbers(df, columns))
    both = numbers.select(
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)])
        )
    ).dropna("any", subset=["x", "y"])
    cells = stable(both.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    blocks = -(-cells.count() // cell_limit)
    result = "pair int, inversions double"
    if blocks <= 1:
        inversions = cells.groupBy("pair").applyInPandas(_inside, result)
    else:
        cells = into_blocks(cells, ["pair", "x", "y"], blocks).withColumnRenamed(BLOCK, "x_block")
        cells = into_blocks(cells, ["pair", "y", "x"], blocks).withColumnRenamed(BLOCK, "y_block")
        inside = cells.select("pair", "x_block", "x", "y", "w").groupBy("pair", "x_block").applyInPandas(_inside, result)
        across = cells.groupBy("pair", "y_block").applyInPandas(_across, result)
        inversions = inside.unionByName(across).unionByName(_between(cells))
    discordant = inversions.groupBy("pair").agg(F.sum("inversions").alias("discordant"))

    def couples(*by: str) -> DataFrame:
        sizes = cells.groupBy("pair", *by).agg(F.sum("w").alias("t"))
        return sizes.groupBy("pair").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("_".join(["tied", *by])))

    counts = cells.groupBy("pair").agg(F.sum("w").cast("long").alias("n"))
    for part in (discordant, couples(), couples("x"), couples("y"), couples("x", "y")):
        counts = counts.join(part, "pair")
    untied_x, untied_y = F.col("tied") - F.col("tied_x"), F.col("tied") - F.col("tied_y")
    surplus = untied_x - F.col("tied_y") + F.col("tied_x_y") - 2 * F.col("discordant")
    found = counts.select("pair", "n", F.try_divide(surplus, F.sqrt(untied_x) * F.sqrt(untied_y)).alias("tau"))
    every = df.sparkSession.range(1).select(F.posexplode(named).alias("pair", "_names"))
    return every.join(found, "pair", "left").select(
        "_names.a", "_names.b", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "tau"
    )


# ---- Cramér's V ----------------------------------------------------------------------------------


def text_association(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, values_a, values_b, chi2, v, reason): Cramér's V with bias correction for all pairs of columns.

    The contingency tables of all pairs come from one aggregation over the rows where both values are known. Columns of
    very many values stay exact: table cells meet their margins by joins, which are split at frequent values. Long texts
    are told apart by length and SHA-256 digest. A pair without rows, with a constant column, or with too few rows for
    the correction has NULL and a reason.
    """
    columns = list(columns)
    pairs = list(combinations(columns, 2))
    texts = df.select(*[short_value(c).alias(c) for c in columns])
    both = texts.select(
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)])
        )
    ).dropna("any", subset=["x", "y"])
    cells = stable(both.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    # stored, so that the joins can be split at a frequent value
    sides = [stable(cells.groupBy("pair", c).agg(F.sum("w").alias(f"w_{c}"))) for c in ("x", "y")]
    shares = cells.join(sides[0], ["pair", "x"]).join(sides[1], ["pair", "y"])
    sums = shares.groupBy("pair").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w") / F.col("w_x") / F.col("w_y")).alias("s")
    )
    sums = sums.join(sides[0].groupBy("pair").agg(F.count(F.lit(1)).alias("values_a")), "pair")
    sums = sums.join(sides[1].groupBy("pair").agg(F.count(F.lit(1)).alias("values_b")), "pair")
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    every = df.sparkSession.range(1).select(F.posexplode(names).alias("pair", "_names"))
    zero = F.lit(0).cast("long")
    rows = every.join(sums, "pair", "left").select(
        "_names.a", "_names.b", F.coalesce(F.col("n").cast("long"), zero).alias("n"),
        F.coalesce("values_a", zero).alias("values_a"), F.coalesce("values_b", zero).alias("values_b"), "s",
    )
    n, r, c = F.col("n").cast("double"), F.col("values_a"), F.col("values_b")
    constant = (r < 2) | (c < 2)
    phi = F.greatest(F.col("s") - 1, F.lit(0.0))
    left = F.greatest(phi - F.try_divide((r - 1) * (c - 1), n - 1), F.lit(0.0))
    room = F.least(r - F.try_divide((r - 1) * (r - 1), n - 1), c - F.try_divide((c - 1) * (c - 1), n - 1)) - 1
    # with as many values as rows nothing is left to compare; the bound is above rounding and below 1 / n
    measurable = ~constant & (room > 1e-12)
    return rows.select(
        "a", "b", "n", "values_a", "values_b",
        F.when(~constant, n * phi).alias("chi2"),
        F.when(measurable, F.sqrt(left / room)).alias("v"),
        F.when(F.col("n") == 0, "no rows").when(constant, "constant column").when(~measurable, "too few rows").alias("reason"),
    )
