"""Change feeds as streaming DataFrames.

A feed row has ``seq`` (arrival order, unique per key), ``body`` (JSON text) and, for
notifications, ``event_type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE_SCHEMA = "seq bigint, body string"
NOTICE_SCHEMA = "seq bigint, event_type string, body string"


def file_feed(
    spark: SparkSession,
    path: str,
    notices: bool = False,
    fmt: str = "json",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Files dropped into a folder: JSON lines or parquet."""
    reader = spark.readStream.schema(NOTICE_SCHEMA if notices else CHANGE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def kafka_feed(spark: SparkSession, servers: str, topic: str, notices: bool = False) -> DataFrame:
    """A topic keyed by record, so that one partition holds all events of a record.

    Needs the Kafka connector on the class path. The offset is the order within a key.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("includeHeaders", str(notices).lower())
        .load()
    )
    order, body = F.col("offset").alias("seq"), F.col("value").cast("string").alias("body")
    if not notices:
        return raw.select(order, body)
    named = F.filter("headers", lambda h: h["key"] == "event_type")
    return raw.select(order, F.get(named, F.lit(0))["value"].cast("string").alias("event_type"), body)
