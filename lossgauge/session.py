"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lossgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI mode, adaptive execution and UTC. ``conf`` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key even where an aggregation on the same key follows
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session, where one machine
    holds all executors, falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="lossgauge-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_scope: ContextVar[list[str] | None] = ContextVar("intermediate tables", default=None)


def intermediate_folder(spark: SparkSession) -> str:
    """A fresh path in the checkpoint folder, deleted at the end of ``intermediate_tables``."""
    folder = f"{checkpoint_dir(spark)}/table_{uuid.uuid4().hex}"
    if (written := _scope.get()) is not None:
        written.append(folder)
    return folder


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it from there.

    This cuts the lineage. Columns such as a partition number become stored data: later passes, and tasks
    re-run after an executor is lost, see the same values. As a columnar table it is read by column,
    and its size is known to the planner.
    """
    path = intermediate_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sorted_buckets(df: DataFrame, keys: Sequence[str]) -> str:
    """Write ``df`` to the checkpoint folder as a table hashed into buckets by ``keys`` and sorted by them in each.

    Such tables meet each other on these keys without a shuffle. There are as many buckets as shuffle partitions, so
    that other data joins them with a shuffle of its own side only. Returns the name, for ``spark.table`` and
    ``drop_buckets``; like other intermediate tables it goes at the end of ``intermediate_tables``.
    """
    spark = df.sparkSession
    folder = intermediate_folder(spark)
    name = folder.rsplit("/", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).saveAsTable(name, format="parquet")
    return name


def drop_buckets(spark: SparkSession, names: Sequence[str]) -> None:
    """Delete tables of ``sorted_buckets`` that nothing reads any more."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, f"{checkpoint_dir(spark)}/{name}")


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Delete on leaving the tables that ``stable`` wrote inside, by this caller only.

    Results that read them must be done by then. Outside of such a block, tables stay with the folder.
    """
    written: list[str] = []
    token = _scope.set(written)
    try:
        yield written
    finally:
        _scope.reset(token)
        for table in written:
            _delete(spark, table)
