"""Order-dependent work that stays spread out when one group holds much of the table.

A window over a group puts the whole group into one task. Every function here first looks at the
size of the largest group. Up to ``group_limit`` rows it uses the plain window. Beyond that, the rows
are range-partitioned on group and order, each range becomes a block, and a group is worked on block by
block: one aggregate row per (group, block) carries the state from block to block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossgauge.session import stable

GROUP_LIMIT = 5_000_000
BLOCK = "_block"


def blocks_needed(df: DataFrame, partition_by: Sequence[str], group_limit: int) -> int:
    """1 if every group has at most ``group_limit`` rows, else the number of blocks of that size.

    Two numbers reach the driver.
    """
    sizes = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("n"))
    largest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    return _blocks(largest or 0, rows or 0, group_limit)


def _blocks(largest: int, rows: int, group_limit: int) -> int:
    return 1 if largest <= group_limit else math.ceil(rows / group_limit)


def into_blocks(df: DataFrame, sort_keys: Sequence[str], blocks: int) -> DataFrame:
    """Range-partition on the sort keys and store the partition number as a column."""
    return stable(df.repartitionByRange(blocks, *sort_keys).withColumn(BLOCK, F.spark_partition_id()))


def _join_cells(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the per-block state. (group, block) pairs are small, so the join is balanced."""
    renamed = cells.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[c for c in cells.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & rows[k].eqNullSafe(renamed[f"_c_{k}"])
    return rows.join(renamed, condition, "left").drop(*[f"_c_{k}" for k in keys])


def running_total(
    df: DataFrame,
    *,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    name: str,
    weight: str | None = None,
    group_limit: int = GROUP_LIMIT,
    blocks: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` (or running row number) per group, as column ``name``.

    ``order_by`` must order the rows of a group without ties. ``blocks`` is for callers that know the sizes.
    """
    if blocks is None:
        blocks = blocks_needed(df, partition_by, group_limit)
    return running_totals(df, partition_by=partition_by, order_by=order_by, totals={name: weight}, blocks=blocks)


def running_totals(
    df: DataFrame, *, partition_by: Sequence[str], order_by: Sequence[str], totals: dict[str, str | None], blocks: int
) -> DataFrame:
    """Several running totals in one pass: ``totals`` maps the new column to its weight, None for a row number."""
    amounts = {name: (F.col(weight) if weight else F.lit(1)).cast("long") for name, weight in totals.items()}
    so_far = (Window.unboundedPreceding, Window.currentRow)

    if blocks == 1:
        group = Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(*so_far)
        return df.withColumns({name: F.sum(amount).over(group) for name, amount in amounts.items()})

    keys = [*partition_by, BLOCK]
    rows = into_blocks(df, [*partition_by, *order_by], blocks)
    earlier = Window.partitionBy(*partition_by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys).agg(*[F.sum(amount).alias(f"_in_block_{i}") for i, amount in enumerate(amounts.values())])
    before = [F.coalesce(F.sum(f"_in_block_{i}").over(earlier), F.lit(0)).alias(f"_before_{i}") for i in range(len(amounts))]
    carried = cells.select(*keys, *before)
    local = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(*so_far)
    return (
        _join_cells(rows, carried, keys)
        .withColumns({name: F.col(f"_before_{i}") + F.sum(amount).over(local) for i, (name, amount) in enumerate(amounts.items())})
        .select(*df.columns, *amounts)
    )


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    bounded: bool = False,
    group_limit: int = GROUP_LIMIT,
    blocks: int | None = None,
) -> DataFrame:
    """Replace NULL by the last non-null value before it in the group.

    Without ``partition_by`` the fill runs over the whole table in the given order, across entities.
    ``order_by`` must order the rows of a group without ties. ``bounded=True`` states that groups are
    small by construction (one row per entity and year) and skips the size check; ``blocks`` is for callers
    that looked the sizes up on a cheaper table. Neither changes the result.
    """
    partition_by, order_by = list(partition_by), list(order_by)
    so_far = (Window.unboundedPreceding, Window.currentRow)

    if bounded:
        blocks = 1
    elif blocks is None and partition_by:
        blocks = blocks_needed(df, partition_by, group_limit)
    elif blocks is None:
        # the whole table is one group: never a single task
        default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(default, math.ceil(df.count() / group_limit))
    if partition_by and blocks == 1:
        group = Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(*so_far)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(group) for c in columns})

    keys = [*partition_by, BLOCK]
    rows = into_blocks(df, [*partition_by, *order_by], blocks)
    position = F.struct(*order_by)
    cells = rows.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_last_{c}") for c in columns]
    )
    # one row per (group, block): without a partition key that is one row per block
    earlier = Window.partitionBy(*partition_by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(
        *keys, *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns]
    )
    local = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(*so_far)
    filled = _join_cells(rows, carried, keys).withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(local), F.col(f"_carry_{c}")) for c in columns}
    )
    return filled.select(*df.columns)


def value_counts_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(group, value, _n) without NULL values; copies collapse before the shuffle."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))


def cumulative_counts(
    df: DataFrame, *, by: Sequence[str], value: str, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """(group, value, _n, _upto, _size): distinct values with count, running count and group size.

    A first pass sketches the number of distinct values of each group, without shuffling a value.
    """
    distinct = df.groupBy(*by).agg(F.approx_count_distinct(value).alias("_values"))
    largest, values = distinct.agg(F.max("_values"), F.sum("_values")).first()
    ranked = running_total(
        value_counts_by(df, by, value),
        partition_by=by,
        order_by=[value],
        weight="_n",
        name="_upto",
        blocks=_blocks(largest or 0, values or 0, group_limit),
    )
    # counted once more rather than stored: one row per group, from one narrow column
    return ranked.join(df.groupBy(*by).agg(F.count(value).alias("_size")), list(by))


def exact_quantiles(
    df: DataFrame,
    *,
    by: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    method: str = "linear",
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Exact interpolated quantiles per group; ``probabilities`` maps output name to probability.

    ``method='linear'`` interpolates at position (n-1)p, as data frames do. ``method='hazen'`` uses
    np - 1/2, as box plots do. The work runs on distinct values with counts.
    """
    ranked = cumulative_counts(df, by=by, value=value, group_limit=group_limit)
    size = F.col("_size")
    picks = []
    for name, p in probabilities.items():
        raw = (size - 1) * F.lit(p) if method == "linear" else size * F.lit(p) - 0.5
        # clipped to the sample, as the plot does for small groups
        position = F.least(F.greatest(raw, F.lit(0.0)), (size - 1).cast("double"))
        floor, ceiling = F.floor(position), F.ceil(position)
        for label, index in (("lo", floor), ("hi", ceiling)):
            holds = (index >= F.col("_upto") - F.col("_n")) & (index < F.col("_upto"))
            picks.append(F.max(F.when(holds, F.col(value).cast("double"))).alias(f"_{name}_{label}"))
        picks.append(F.max(position - floor).alias(f"_{name}_part"))
    picked = ranked.groupBy(*by).agg(F.max(size).alias("n"), *picks)
    return picked.select(
        *by,
        "n",
        *[
            (
                F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_part")
            ).alias(name)
            for name in probabilities
        ],
    )
