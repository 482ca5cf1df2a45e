"""Describe results, object catalogues and snapshots read from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.naming import non_blank

DESCRIBE_SCHEMA = (
    "fields array<struct<name string, type string, label string, length int, "
    "precision string, scale string>>"
)
CATALOGUE_SCHEMA = (
    "records array<struct<QualifiedApiName string, Label string, DurableId string, "
    "IsQueryable boolean>>, nextRecordsUrl string"
)


def describe_fields(spark: SparkSession, path: str) -> DataFrame:
    """One row per field of the describe documents under ``path``."""
    docs = spark.read.schema(DESCRIBE_SCHEMA).json(path, multiLine=True)
    return docs.select(F.inline("fields"))


def fields_from_text(docs: DataFrame, body: str = "body") -> DataFrame:
    """The same, for describe documents held in a text column; other columns are kept."""
    keep = [c for c in docs.columns if c != body]
    return docs.select(*keep, F.inline(F.from_json(body, DESCRIBE_SCHEMA)["fields"]))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """All result pages of an object listing: named, queryable objects (S3, F8)."""
    return catalogue_rows(spark.read.schema(CATALOGUE_SCHEMA).json(path, multiLine=True))


def catalogue_rows(pages: DataFrame) -> DataFrame:
    r = pages.select(F.inline("records"))
    named = r.where(non_blank(F.col("QualifiedApiName")).isNotNull())
    named = named.where(F.coalesce("IsQueryable", F.lit(True)))
    name = F.col("QualifiedApiName")
    return named.select(
        F.coalesce("DurableId", name).alias("durable_id"),
        name.alias("name"),
        F.coalesce("Label", name).alias("label"),
    )


def snapshot_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of a snapshot's result pages, as JSON text."""
    pages = spark.read.text(path, wholetext=True)
    return record_texts(pages.withColumnRenamed("value", "body"))


def record_texts(pages: DataFrame) -> DataFrame:
    page = F.from_json("body", "records array<string>")
    return pages.select(F.explode(page["records"]).alias("body"))


def notice_fields(describe: DataFrame) -> DataFrame:
    """Fields a notification feed may carry: long text is left out."""
    return describe.where(F.col("type") != "textarea")


def change_entity(name: Column) -> Column:
    """Object name to the name of its change events; change event names stay."""
    return (
        F.when(name.endswith("ChangeEvent"), name)
        .when(name.endswith("__c"), F.regexp_replace(name, "__c$", "__ChangeEvent"))
        .otherwise(F.concat(name, F.lit("ChangeEvent")))
    )


def entity_of_change(name: Column) -> Column:
    """The inverse of ``change_entity``."""
    return F.when(name.endswith("__ChangeEvent"), F.regexp_replace(name, "__ChangeEvent$", "__c")).otherwise(
        F.regexp_replace(name, "ChangeEvent$", "")
    )
