"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import pickle
import sys
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root

#: A key with this many rows, and with a hundred-thousandth of all rows, is heavy: there are at
#: most ``HEAVY_KEYS`` such keys whatever the input, few enough to broadcast.
HEAVY_ROWS, HEAVY_KEYS = 1_000, 100_000

#: Writer's options for tables of rows of some 100 kB: a reader holds a whole row group at a time.
WIDE_ROWS = {"parquet.block.row.count.limit": "64"}

#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def boxed(df: DataFrame) -> Column:
    """All columns as one struct, so that none can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def unboxed(columns: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a ``_row``, but those that an operator replaces."""
    return [F.col(f"_row.`{c}`").alias(c) for c in columns if c not in without]


def join_counted(rows: DataFrame, unique: DataFrame, keys: list[str], count: str = "_n") -> DataFrame:
    """Inner join of rows with one row a key, whose ``count`` says how many of the rows have the key.

    Rows of heavy keys meet their broadcast row where they are, so no task gets all rows of a
    key; the others are shuffled. ``count`` is dropped. Both sides are best written tables.
    """
    total = unique.agg(F.sum(count).alias("n"), F.max(count).alias("most")).first()
    least = max(HEAVY_ROWS, -(-(total.n or 0) // HEAVY_KEYS))
    if (total.most or 0) < least:
        return rows.join(unique.drop(count), keys)
    heavy = F.broadcast(unique.where(F.col(count) >= least).drop(count))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(unique.where(F.col(count) < least).drop(count), keys)
    return rows.join(heavy, keys).select(*light.columns).union(light)


def new_folder(spark: SparkSession, what: str) -> str:
    """An unused path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{what}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """(file system, path) of a shared folder, for readers and writers inside tasks."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(uri)


def worker_state(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that lives as long as the Python worker, for all tasks it runs."""
    kept = vars(sys.modules["__main__"]).setdefault("_tidemark_state", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Return the memory that a Python worker has freed; it outlives its task, idle beside the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, compressed; small ones take a byte or two."""
    return pa.compress(values.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``packed``."""
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), "<i4").astype(np.int64)


def carry(spark: SparkSession, value: Any, slot: str) -> Callable[[], Any]:
    """A value of bounded size for tasks; its classes travel with it, so workers need no package.

    A worker keeps the last value of a slot, whatever the number of tasks it runs.
    """
    held, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: last_state(slot, key, lambda: pickle.loads(held.value))


def last_state(slot: str, key: str, make: Callable[[], Any]) -> Any:
    """An object of the Python worker; only the last one of a slot is kept."""
    kept = vars(sys.modules["__main__"]).setdefault("_tidemark_state", {})
    if kept.get(slot, (None, None))[0] != key:
        kept.pop(slot, None)
        kept[slot] = key, make()
    return kept[slot][1]
