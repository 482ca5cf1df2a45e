"""Describe rows to table columns (P22, C18-C20 and the type table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.columns import KEY, LAST_EVENT, LAST_MODIFIED, strip
from tidemark.functions.coerce import spark_type

# Column types per dialect. ``{n}`` is the declared length.
_TEXT_TYPES = ("string", "picklist", "multipicklist", "phone", "url")
_DIALECTS: dict[str, dict[str, str]] = {
    "MYSQL": {
        "key": "VARCHAR(18)", "long": "TEXT", "boolean": "BOOLEAN", "datetime": "DATETIME(6)",
        "date": "DATE", "time": "TIME(6)", "double": "DOUBLE", "int": "INT",
        "text": "VARCHAR", "other": "VARCHAR(255)",
    },
    "POSTGRESQL": {
        "key": "VARCHAR(18)", "long": "TEXT", "boolean": "BOOLEAN", "datetime": "TIMESTAMP(6)",
        "date": "DATE", "time": "TIME(6)", "double": "DOUBLE PRECISION", "int": "INTEGER",
        "text": "VARCHAR", "other": "VARCHAR(255)",
    },
    "ORACLE": {
        "key": "VARCHAR2(18)", "long": "CLOB", "boolean": "NUMBER(1)", "datetime": "TIMESTAMP(6)",
        "date": "DATE", "time": "VARCHAR2(18)", "double": "BINARY_DOUBLE", "int": "NUMBER(10)",
        "text": "VARCHAR2", "other": "VARCHAR2(255)",
    },
}
_DIALECTS["MARIADB"] = _DIALECTS["MYSQL"]
LONG_TEXT_LIMIT = 4000


def column_type(dialect: str, source_type: Column, length: Column) -> Column:
    """Database column type of a described field (C20)."""
    names = _DIALECTS[dialect]
    mysql = dialect in ("MYSQL", "MARIADB")
    shortest = 1 if mysql else 255
    n = F.greatest(F.coalesce(length, F.lit(0)), F.lit(shortest)).cast("string")
    text = F.concat(F.lit(names["text"] + "("), n, F.lit(")"))
    long_text = F.lit(names["long"])
    if mysql:
        declared = F.concat(F.lit(names["text"] + "("), length.cast("string"), F.lit(")"))
        long_text = F.when(length > LONG_TEXT_LIMIT, long_text).otherwise(declared)
    return (
        F.when(source_type.isin("id", "reference"), names["key"])
        .when(source_type == "textarea", long_text)
        .when(source_type.isin(*_TEXT_TYPES), text)
        .when(source_type.isin("double", "percent", "currency"), names["double"])
        .when(source_type == "boolean", names["boolean"])
        .when(source_type == "datetime", names["datetime"])
        .when(source_type == "date", names["date"])
        .when(source_type == "time", names["time"])
        .when(source_type == "int", names["int"])
        .otherwise(names["other"])
    )


def comment(label: Column) -> Column:
    """Field label as a column comment: quotes become backquotes."""
    return F.translate(label, "'", "`")


def effective_label(label: Column, name: Column) -> Column:
    """The name, where the label is missing."""
    missing = label.isNull() | (strip(label) == "") | label.startswith("__MISSING LABEL__")
    return F.when(missing, name).otherwise(label)


def schema_table(describe: DataFrame, dialect: str) -> DataFrame:
    """Columns of the target table, one row each: name, type, comment."""
    key = F.col("type") == "id"
    columns = describe.select(
        F.when(key, KEY).otherwise(F.col("name")).alias("column_name"),
        column_type(dialect, F.col("type"), F.col("length")).alias("column_type"),
        comment(F.coalesce("label", F.lit(""))).alias("comment"),
    )
    times = describe.sparkSession.range(1).select(
        F.explode(F.array(F.lit(LAST_MODIFIED), F.lit(LAST_EVENT))).alias("column_name"),
        F.lit(_DIALECTS[dialect]["datetime"]).alias("column_type"),
        F.lit(None).cast("string").alias("comment"),
    )
    return columns.unionByName(times)


def struct_type(fields: list[dict]) -> T.StructType:
    """Spark schema of a target table from one object's describe rows.

    A describe result is one object's field list, which the source bounds to some hundred.
    """
    out = []
    for f in fields:
        name, key = f["name"], f["type"] == "id"
        label = (f.get("label") or "").replace("'", "`")
        kind = T.StringType() if key else spark_type(f["type"])
        out.append(T.StructField(KEY if key else name, kind, not key, {"comment": label}))
    for name in (LAST_MODIFIED, LAST_EVENT):
        out.append(T.StructField(name, T.TimestampType()))
    return T.StructType(out)


def field_types(fields: list[dict]) -> dict[str, str]:
    """Source type per field name, without the key."""
    return {f["name"]: f["type"] for f in fields if f["type"] != "id"}
