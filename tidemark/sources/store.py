"""A keyed target table on plain parquet, changed batch by batch.

The table is a folder of parquet files partitioned by ``_bucket``, a hash of the key, and
sorted by key: any engine can read it. A batch joins its rows with the stored rows of the
buckets its keys fall in, in one plan, and its result replaces these buckets by a dynamic
partition overwrite. Choose the number of buckets so that one is worth rewriting for a few
changed keys (some 100 MB), and a trigger that gathers enough changes; where the catalog has
tables that support MERGE, ``DataFrame.mergeInto`` writes less.

A batch's result is written to a staging folder first, and copied into the table when it is
complete. So a job that fails, or a batch that is refused, leaves the table as it was; and a
batch that was interrupted while it was copied is copied again from what was staged, not
applied a second time to rows that it already changed. The last batch of each feed is kept
beside the table, so a replayed batch is skipped. A reader that scans while buckets are being
replaced may see some of them before the batch and some after it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.columns import KEY
from tidemark.session import delete_folder, folder_exists, subfolders

BUCKET = "_bucket"


class KeyedTable:
    """Rows by key (one column, or several) below ``path``, with its columns given by ``schema``."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64, key: str | Sequence[str] = KEY
    ) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self.keys = [key] if isinstance(key, str) else list(key)
        self._data = f"{self.path}/data"

    @property
    def key(self) -> str:
        if len(self.keys) != 1:
            raise ValueError("the table has several key columns")
        return self.keys[0]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # -- reading --------------------------------------------------------------------
    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows; with ``buckets``, only their folders are read."""
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not folder_exists(self.spark, self._data):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(stored).parquet(self._data)
        return (rows if buckets is None else rows.where(F.col(BUCKET).isin(list(buckets)))).drop(BUCKET)

    def count(self) -> int:
        return self.read().count()

    def last_batch(self, feed: str) -> str | None:
        """The name of the batch of a feed that was applied last."""
        folder = f"{self.path}/applied/{feed}"
        row = self.spark.read.schema("batch string").parquet(folder).first() if folder_exists(self.spark, f"{folder}/_SUCCESS") else None
        return row and row.batch

    # -- writing --------------------------------------------------------------------
    def staging(self, batch: str) -> str:
        return f"{self.path}/staged/{batch}"

    def is_staged(self, batch: str) -> bool:
        return folder_exists(self.spark, f"{self.staging(batch)}/touched/_SUCCESS")

    def is_applied(self, batch: str) -> bool:
        """Whether the batch is the last one of its feed, the part of its name before the last dash."""
        return self.last_batch(batch.rpartition("-")[0]) == batch

    def commit(self, batch: str, changed: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> bool:
        """Apply a batch to the stored rows of the buckets of ``changed``.

        ``apply(stored rows of these buckets)`` gives all their new rows; rows with a false
        ``present`` column are left out. Returns False for a batch that was applied already: a
        replay after a restart, or a snapshot that is loaded again.
        """
        if self.is_applied(batch):
            return False
        if not self.is_staged(batch):
            self.stage(batch, changed, apply)
        self.publish(batch)
        return True

    def stage(
        self,
        batch: str,
        changed: DataFrame,
        apply: Callable[[DataFrame], DataFrame],
        totals: dict[str, Column] | None = None,
    ) -> dict[str, int]:
        """Write a batch's result beside the table; ``totals`` over its rows, taken while they are written.

        The totals include rows that end up absent. They belong to the last step of the write,
        where a task that is run again doesn't count twice.
        """
        # At most one row per bucket.
        touched = self._touched(changed)
        observed = Observation(f"batch {batch}")
        rows = apply(self.read([r[BUCKET] for r in touched.collect()]))
        rows = rows.withColumn(BUCKET, self.bucket()).hint("rebalance", F.col(BUCKET))
        if totals:
            rows = rows.observe(observed, *[c.alias(n) for n, c in totals.items()])
        if "present" in rows.columns:
            rows = rows.where("present")
        rows = rows.select(*self.schema.names, BUCKET).sortWithinPartitions(BUCKET, *self.keys)
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.staging(batch)}/rows")
        # Written last: a staged batch without it is staged anew.
        touched.coalesce(1).write.mode("overwrite").parquet(f"{self.staging(batch)}/touched")
        return dict(observed.get) if totals else {}

    def _touched(self, changed: DataFrame) -> DataFrame:
        return changed.select(self.bucket().alias(BUCKET)).distinct()

    def publish(self, batch: str) -> None:
        """Replace the touched buckets by what was staged; may be repeated after a failure."""
        folder, stored = self.staging(batch), T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        touched = {r[0] for r in self.spark.read.schema(f"{BUCKET} int").parquet(f"{folder}/touched").collect()}
        filled = {int(name.partition("=")[2]) for name in subfolders(self.spark, f"{folder}/rows")}
        if filled:
            rows = self.spark.read.schema(stored).parquet(f"{folder}/rows").hint("rebalance", F.col(BUCKET))
            writer = rows.sortWithinPartitions(BUCKET, *self.keys).write.mode("overwrite").partitionBy(BUCKET)
            writer.option("partitionOverwriteMode", "dynamic").parquet(self._data)
        for b in touched - filled:  # all rows of the bucket are gone
            delete_folder(self.spark, f"{self._data}/{BUCKET}={b}")
        feed = batch.rpartition("-")[0]
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/applied/{feed}")
        delete_folder(self.spark, folder)

    def drop(self) -> None:
        """Remove the table and all that is kept beside it."""
        delete_folder(self.spark, self.path)


def upsert_into(
    table: KeyedTable, batch: str, incoming: DataFrame, upsert: Callable[[DataFrame, DataFrame], DataFrame]
) -> bool:
    """Multi-row insert with an upsert tail (S10): ``upsert(stored, incoming)`` on the buckets of the incoming keys."""
    return table.commit(batch, incoming, lambda stored: upsert(stored, incoming))


def row_count(spark: SparkSession, table: str) -> int:
    """Rows of a named table; 0, with a warning, when it does not exist or cannot be read."""
    try:
        return spark.table(table).count()
    except Exception as e:  # any failure yields 0
        warnings.warn(f"rows of {table} could not be counted: {str(e).splitlines()[0][:200]}", stacklevel=2)
        return 0
