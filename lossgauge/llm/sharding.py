"""Placement of rows on shards through a permutation-filled lookup table.

Each shard ranks the slots of a prime-sized table by its own permutation; shards take turns, and each claims the first
slot of its ranking that is free, until the table is full. A row's key is hashed to a slot, and the slot names the
shard. Shards get slot counts that differ by one at most, and adding or removing a shard moves little more than that
shard's own share. The table has a fixed, stated size, so it is broadcast; placing a row needs no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lossgauge.llm.common import free_names

SLOTS = 65_537
# a table of this size is a few megabytes, whatever the data
MOST_SLOTS = 1 << 20
ROWS_PER_FILE = 100_000


def _permutation(shard: str, slots: int) -> tuple[int, int]:
    """First slot of a shard's ranking, and the step to the next; any step reaches all of a prime number of slots."""
    digest = hashlib.sha256(shard.encode()).digest()
    first, step = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big")
    return first % slots, step % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot. ``slots`` must be prime."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("name at least one shard, and each once")
    if not len(shards) <= slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at, steps = map(list, zip(*(_permutation(s, slots) for s in shards)))
    table, free = [-1] * slots, slots
    while free:
        for shard, step in enumerate(steps):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step) % slots
            table[slot], at[shard] = shard, (slot + step) % slots
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard) of a lookup table, unpacked from one literal."""
    listed = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard"))


def place(docs: DataFrame, shards: Sequence[str], keys: Sequence[str] = ("doc_id",), slots: int = SLOTS) -> DataFrame:
    """``docs`` with slot and shard (number in ``shards``) added; a column of the same name is replaced.

    Rows with equal keys share a shard; to spread the rows of a key, add a column that tells them apart. A null key has
    a slot like any other. Repeated rows go to one shard; no rows give no rows.
    """
    table = table_frame(docs.sparkSession, lookup_table(shards, slots))
    own_slot, table_slot, table_shard = free_names(docs, "__slot", "__table_slot", "__shard")
    own = docs.withColumn(own_slot, F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(slots)).cast("int"))
    table = table.select(F.col("slot").alias(table_slot), F.col("shard").alias(table_shard))
    placed = own.join(F.broadcast(table), F.col(own_slot) == F.col(table_slot))
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    return placed.select(*kept, F.col(own_slot).alias("slot"), F.col(table_shard).alias("shard"))


def write_shards(placed: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per shard, of files of about ``rows_per_file`` rows.

    The rows of a shard are dealt by turns to as many tasks as it has files, so no task holds a whole shard, and equal
    rows don't meet in one. No rows write no file.
    """
    shards = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-shards // rows_per_file))
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    (dealt,) = free_names(placed, "__turn")
    placed.withColumn(dealt, turn).repartition("shard", dealt).drop(dealt).write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str, columns: StructType) -> DataFrame:
    """The rows of all shards, with the shard from the folder a row lies in; ``columns`` are those that were written."""
    return spark.read.schema(columns).parquet(folder)
