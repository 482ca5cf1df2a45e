"""Pages deep in an ordered listing.

``offset`` sorts all rows up to the page on every call. Here the rows are dealt out once by
range of their order, a folder of parquet files a range, with a count a range beside them. The
running counts tell which ranges a page lies in, mostly one; only their files are read and only
their rows sorted, whatever the number of the page.

A range costs a task, a folder and bounds that the driver holds. So small ranges, which suit a
short listing, are only made up to ``RANGES`` of them; a longer listing has as many, of more
rows each, up to ``RANGE_ROWS``, and from there on more ranges again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_folder

#: Rows of a range, which one task sorts for a page.
RANGE_ROWS = 100_000
#: Ranges that may have fewer rows than that.
RANGES = 256
PART = "_range"


class OrderIndex:
    """An ordered listing written below ``path``; ``order`` makes every row's place unique."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, order: Sequence[Column]) -> None:
        self.spark, self.path, self.schema, self.order = spark, path, schema, list(order)

    def _counts(self) -> DataFrame:
        """(range, rows, rows before it): one row a range."""
        counts = self.spark.read.schema(f"{PART} int, n bigint").parquet(f"{self.path}/counts")
        before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def total(self) -> DataFrame:
        """One row: how many rows the listing has."""
        return self._counts().agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))

    def page(self, page: int, size: int) -> DataFrame:
        """The rows of a page, from 1, in order."""
        start = (max(page, 1) - 1) * size
        met = self._counts().where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start) & (F.col("n") > 0))
        # As many ranges as the page touches.
        ranges = sorted((r[PART], r.before) for r in met.select(PART, "before").collect())
        if not ranges:
            return self.spark.createDataFrame([], self.schema)
        # No other range's folder is even listed.
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{PART}={p}" for p, _ in ranges])
        return rows.orderBy(*self.order).offset(start - ranges[0][1]).limit(size)


def range_count(rows: int, range_rows: int) -> int:
    """Ranges of a listing, of about ``range_rows`` rows where that makes no great number of them."""
    return max(1, min(math.ceil(rows / range_rows), max(RANGES, math.ceil(rows / RANGE_ROWS))))


def index_order(rows: DataFrame, order: Sequence[Column], path: str | None = None, range_rows: int = RANGE_ROWS) -> OrderIndex:
    """Write an ordered listing, which any number of pages may then be taken from."""
    spark = rows.sparkSession
    path = path or shared_folder(spark, "listings")
    parts = range_count(rows.count(), range_rows)
    dealt = rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id())
    dealt.write.partitionBy(PART).parquet(f"{path}/rows")
    stored = T.StructType([*rows.schema.fields, T.StructField(PART, T.IntegerType())])
    counts = spark.read.schema(stored).parquet(f"{path}/rows").groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/counts")
    return OrderIndex(spark, path, rows.schema, order)
