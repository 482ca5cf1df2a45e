"""Session settings and the two size-checked helpers the jobs share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have before an explicit broadcast is dropped for a shuffle join.
BROADCAST_ROWS = 500_000
#: Splits a core from which on an input is taken to be spread evenly.
SPLITS_PER_CORE = 4


def build_session(app: str, master: str, shuffle_partitions: int) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """All stored times are UTC, so the session has to read and print UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return named or current
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


#: Folders that the innermost ``temporary_tables`` removes.
_TEMPORARY: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what ``cut_lineage`` wrote inside; nothing that reads it may be left."""
    paths: list[str] = []
    token = _TEMPORARY.set(paths)
    try:
        yield
    finally:
        _TEMPORARY.reset(token)
        for path in paths:
            delete_folder(spark, path)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def folder_exists(spark: SparkSession, path: str) -> bool:
    system, folder = _folder(spark, path)
    return system.exists(folder)


def delete_folder(spark: SparkSession, path: str) -> None:
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a folder."""
    system, folder = _folder(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(folder) if s.isDirectory()) if system.exists(folder) else []


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """The rows, written once as a table in the shared folder and read back.

    Survives lost executors. Cheaper than ``checkpoint()``, which computes its rows twice,
    and read back by column. ``options`` are the writer's.
    """
    path = shared_folder(df.sparkSession, "tables")
    if (temporary := _TEMPORARY.get()) is not None:
        temporary.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_partitions(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps the partitions and their order.

    Taken with the first job that reads the rows.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=False)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose row count the caller has measured, if it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input of few splits over all cores, ahead of work that is heavy per row.

    Splits of a file hold whole row groups, so of few splits some may hold most rows and others
    none. An input with several splits a core, as any large one has, is left alone.
    """
    parts = SPLITS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
