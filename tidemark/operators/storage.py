"""Storage registrations: normalising, checking, listing and changing them.

(C16-C18 of a registry, J1, O8, F9, F11, A13, K16-K18.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.registry import last_per_key
from tidemark.columns import strip
from tidemark.functions.naming import connection, connection_url, non_blank, storage_schema_name

# Vendors, page sizes, sort names, the database of a Postgres storage.
VENDORS = ("MARIADB", "MYSQL", "ORACLE", "POSTGRESQL")
PAGE_DEFAULT, PAGE_MAX = 20, 100
SORT_COLUMNS = {
    "id": "id",
    "name": "name",
    "vendor": "vendor",
    "status": "connection_status",
    "connectionstatus": "connection_status",
    "connection_status": "connection_status",
    "authtype": "auth_method",
    "authmethod": "auth_method",
    "type": "storage_type",
    "storagetype": "storage_type",
}
CERTIFICATE_FIELDS = ("trust_store_path", "trust_store_password", "key_store_path", "key_store_password")


def _missing(c: str) -> Column:
    return non_blank(F.col(c)).isNull()


def validate(registrations: DataFrame) -> DataFrame:
    """Registrations with ``reject_reason``: the first rule a row breaks, or null."""
    password = F.col("auth_method") == "PASSWORD"
    reason = (
        F.when(F.col("vendor").isNull(), "vendor")
        .when(F.col("auth_method").isNull(), "auth_method")
        .when(_missing("raw_url"), "raw_url")
        .when(F.col("port") <= 0, "port")
        .when(_missing("name"), "name")
        .when((F.col("vendor") == "ORACLE") & _missing("schema_name") & _missing("username"), "schema_context")
        .when(password & _missing("username"), "username")
        .when(password & _missing("password"), "password")
    )
    for c in CERTIFICATE_FIELDS:
        if c in registrations.columns:
            reason = reason.when(~password & _missing(c), c)
    return registrations.withColumn("reject_reason", reason)


def normalize(registrations: DataFrame) -> DataFrame:
    """Connection parts, canonical URL and schema name of each registration.

    An unreadable address is rejected. A port given beside the address wins over the one in it.
    """
    parsed = registrations.withColumn("_c", connection(F.col("vendor"), F.col("raw_url")))
    vendor, c = F.col("vendor"), F.col("_c")
    port = F.coalesce(F.col("port"), c["port"])
    # An Oracle address without service or sid takes the schema name as its service.
    service = F.when(
        (vendor == "ORACLE") & c["service"].isNull() & c["sid"].isNull(), strip(non_blank(F.col("schema_name")))
    ).otherwise(c["service"])
    return parsed.select(
        *[x for x in registrations.columns if x not in ("port", "schema_name")],
        c["host"].alias("host"),
        F.when(c["host"].isNotNull(), port).alias("port"),
        c["database"].alias("database_name"),
        service.alias("service_name"),
        c["sid"].alias("sid"),
        connection_url(vendor, c["host"], port, c["database"], service, c["sid"]).alias("jdbc_url"),
        storage_schema_name(vendor, F.col("schema_name"), F.col("username")).alias("schema_name"),
        F.when(c["host"].isNull(), "address").alias("address_reject"),
    )


def joined(headers: DataFrame, details: DataFrame) -> DataFrame:
    """Headers with their details, one to one."""
    return headers.join(details, headers["id"] == details["storage_id"]).drop("storage_id")


def listing(
    storages: DataFrame, page: int = 0, size: int = 0, sort_by: str | None = None, direction: str | None = None
) -> DataFrame:
    """One page of the storages (O8); an unknown sort name sorts by id."""
    n = PAGE_DEFAULT if size <= 0 else min(size, PAGE_MAX)
    column = SORT_COLUMNS.get((sort_by or "id").strip().lower(), "id")
    down = (direction or "").lower() == "desc"
    first = F.col(column).desc() if down else F.col(column).asc()
    return storages.orderBy(first, F.col("id")).offset(max(page, 0) * n).limit(n)


def totals(storages: DataFrame, size: int = 0) -> DataFrame:
    """Total and number of pages."""
    n = PAGE_DEFAULT if size <= 0 else min(size, PAGE_MAX)
    counted = storages.agg(F.count(F.lit(1)).alias("total"))
    return counted.withColumn("pages", F.ceil(F.col("total") / n).cast("bigint"))


def options(storages: DataFrame) -> DataFrame:
    """Enabled storages by name."""
    return storages.where("enabled").orderBy("name", "id")


def edit(headers: DataFrame, edits: DataFrame) -> DataFrame:
    """New name and description by id; an edited storage is PENDING again."""
    e = last_per_key(edits.select("id", "name", "description"), ["id"]).select("id", F.col("name").alias("_name"), F.col("description").alias("_desc"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    return headers.join(e, "id", "left").withColumns(
        {
            "name": F.when(hit, F.col("_name")).otherwise(F.col("name")),
            "description": F.when(hit, non_blank(F.col("_desc"))).otherwise(F.col("description")),
            "connection_status": F.when(hit, "PENDING").otherwise(F.col("connection_status")),
        }
    ).select(*headers.columns)


def record_tests(headers: DataFrame, tests: DataFrame) -> DataFrame:
    """Latest connection test per storage (id, success, message, tested_at) into its row."""
    last = tests.groupBy("id").agg(F.max_by(F.struct("success", "message", "tested_at"), "tested_at").alias("t"))
    hit, t = F.col("t").isNotNull(), F.col("t")
    return headers.join(last, "id", "left").withColumns(
        {
            "connection_status": F.when(hit, F.when(t["success"], "VERIFIED").otherwise("FAILED")).otherwise(
                F.col("connection_status")
            ),
            "last_test_success": F.when(hit, t["success"]).otherwise(F.col("last_test_success")),
            "last_error_message": F.when(hit & ~t["success"], t["message"])
            .when(hit, None)
            .otherwise(F.col("last_error_message")),
            "last_tested_at": F.when(hit, t["tested_at"]).otherwise(F.col("last_tested_at")),
        }
    ).select(*headers.columns)


def test_events(headers: DataFrame, tests: DataFrame, kind: str = "TEST") -> DataFrame:
    """The history event of every test (id, success, message, tested_at) of a known storage.

    ``kind`` is TEST, REGISTER, UPDATE or DECRYPT.
    """
    known = tests.join(headers.select("id").distinct(), "id", "left_semi")
    return known.select("id", F.lit(kind).alias("kind"), "success", F.when(~F.col("success"), F.col("message")).alias("message"), "tested_at")


def cascade_delete(deleted: DataFrame, child: DataFrame, child_id: str = "storage_id") -> DataFrame:
    """The rows of a child table whose storage was not deleted."""
    d = deleted.select(F.col("id").alias("_id"))
    return child.join(d, F.col(child_id) == F.col("_id"), "left_anti")


def backfill_url(details: DataFrame) -> DataFrame:
    """Connection URL from the stored parts where it is missing."""
    at = F.concat_ws(":", "host", F.col("port").cast("string"))
    tcp = F.concat(F.lit("jdbc:"), F.lower("vendor"), F.lit("://"), at, F.lit("/"), F.coalesce("database_name", F.lit("")))
    derived = (
        F.when(F.col("vendor").isin("MARIADB", "MYSQL", "POSTGRESQL"), tcp)
        .when(F.col("vendor") != "ORACLE", None)
        .when(F.col("service_name") != "", F.concat(F.lit("jdbc:oracle:thin:@//"), at, F.lit("/"), F.col("service_name")))
        .when(F.col("sid") != "", F.concat(F.lit("jdbc:oracle:thin:@"), at, F.lit(":"), F.col("sid")))
    )
    return details.withColumn("jdbc_url", F.coalesce("jdbc_url", derived))
