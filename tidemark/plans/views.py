"""Change feeds, snapshots, routes and file lists derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import spread, use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str | Column) -> Column:
    """Microseconds since 1970 of a UTC wall-clock or instant column."""
    return F.unix_micros(F.col(col).cast("timestamp") if isinstance(col, str) else col)


def utc(micros_col: Column) -> Column:
    return F.timestamp_micros(micros_col)


#: Last-modified times of the derived mutations run 0 to 6 days behind their event times.
LAG_DAYS = 7
DAY = 86_400_000_000


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation per row of ``events``: the user is the key, the event id the order."""
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "signup", "CREATE")
        .when(F.col("event_type") == "view", "UNDELETE")
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("UPDATE")
    )
    ev = micros("ts")
    return e.select(
        F.col("user_id").alias("sfid"),
        F.col("event_id").alias("seq"),
        kind.alias("change_type"),
        utc(ev - F.pmod("event_id", F.lit(LAG_DAYS)) * DAY).alias("lm"),
        utc(ev).alias("ev"),
        F.when(F.col("event_type") == "click", F.array(F.lit("value")))
        .otherwise(F.array(F.lit("value"), F.lit("props")))
        .alias("target_fields"),
        F.struct("value", "props").alias("vals"),
    )


def sparse_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with small values touching nothing, and some missing times."""
    v = F.col("vals.value")
    m = mutations(spark, sf_dir)
    return m.withColumns(
        {
            "target_fields": F.when(v < 10, F.array().cast("array<string>")).otherwise(F.col("target_fields")),
            "lm": F.when((v >= 60) & (v < 70), None).otherwise(F.col("lm")),
            "ev": F.when((v >= 65) & (v < 75), None).otherwise(F.col("ev")),
        }
    )


def skewed_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the events of a third of the users on one key."""
    third = F.pmod("sfid", F.lit(3)) == 0
    return mutations(spark, sf_dir).withColumn("sfid", F.when(third, 0).otherwise(F.col("sfid")).cast("bigint"))


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a stored row with the columns the mutations write."""
    c = table(spark, sf_dir, "customer")
    start = 1_704_067_200_000_000  # 2024-01-01
    return c.select(
        F.col("c_custkey").alias("sfid"),
        F.col("c_acctbal").alias("value"),
        F.col("c_name").alias("props"),
        utc(F.lit(start) + F.pmod("c_custkey", F.lit(30)) * DAY).alias("_oc_last_modified_at"),
        utc(F.lit(start) + F.pmod("c_custkey", F.lit(20)) * DAY).alias("_oc_last_event_at"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored, incoming) rows by customer: from their first order, and from their last.

    Keys of the stored side come from orders of odd-numbered customers, so that the full
    join has matched and unmatched keys on both sides.
    """
    o = table(spark, sf_dir, "orders")
    us = micros("o_orderdate")
    early = o.where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_custkey").alias("sfid")).agg(
        F.max("o_totalprice").alias("amount"), F.min("o_orderstatus").alias("status"),
        F.max(us).alias("us"), F.min(us).alias("first_us"),
    )
    late = o.where("o_orderpriority = '5-LOW'").groupBy(F.col("o_custkey").alias("sfid")).agg(
        F.max("o_totalprice").alias("amount"), F.max("o_orderstatus").alias("status"),
        F.max(us).alias("us"), F.min(us).alias("first_us"),
    )

    def rows(df: DataFrame) -> DataFrame:
        return df.select(
            "sfid", "amount", "status",
            F.when(F.col("amount") > 20000, utc(F.col("us"))).alias("_oc_last_modified_at"),
            utc(F.col("first_us")).alias("_oc_last_event_at"),
        )

    return rows(early), rows(late)


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two routes per customer; the nations are the organisations."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    org = F.lower(F.concat_ws(".", "n_name", "r_name", F.lit("example.com")))
    protocols = (
        F.when(seg == "AUTOMOBILE", F.array(F.lit("CDC")))
        .when(seg == "BUILDING", F.array(F.lit("CDC"), F.lit("STREAMING")))
        .otherwise(F.array(F.lit("STREAMING")))
    )
    base = 946_684_800_000_000  # 2000-01-01
    at = utc(F.lit(base) + F.col("c_custkey") * 60_000_000)
    idle = (seg == "MACHINERY") & (bal > 5000)
    return j.select(
        org.alias("org_key"),
        F.col("n_name").alias("org_name"),
        F.concat(F.lit("https://"), org).alias("my_domain"),
        F.col("n_nationkey").cast("bigint").alias("target_storage_id"),
        F.concat(F.lit("storage "), F.col("r_name")).alias("target_storage_name"),
        F.concat(F.lit("org_"), F.lower("n_name")).alias("target_schema"),
        F.col("c_name").alias("target_table"),
        F.col("r_name").alias("instance_name"),
        F.concat(F.lit("Edition "), F.col("n_regionkey").cast("string")).alias("org_type"),
        (F.col("n_regionkey") == 0).alias("is_sandbox"),
        F.col("c_name").alias("selected_object"),
        F.concat(F.lit("Label "), F.col("c_custkey").cast("string")).alias("object_label"),
        F.explode(protocols).alias("routing_protocol"),
        F.when((seg == "HOUSEHOLD") & (bal < 0), "RELEASED").when(bal < 0, "FAILED").when(idle, "INACTIVE")
        .when((seg == "FURNITURE") & (bal > 9000), None).otherwise("ACTIVE").alias("routing_status"),
        F.when(bal < -500, "ERROR").when(idle, "INACTIVE").otherwise("ACTIVE").alias("source_status"),
        F.lit(None).cast("string").alias("last_error_message"),
        at.alias("activated_at"),
        F.lit(None).cast("timestamp").alias("released_at"),
        at.alias("last_synced_at"),
        F.lit("seed").alias("created_by"),
        F.lit("seed").alias("updated_by"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


#: The same routes in DuckDB, as a common table expression body.
ROUTES_SQL = """
SELECT lower(n_name||'.'||r_name||'.example.com') AS org_key, n_name AS org_name,
       'https://'||lower(n_name||'.'||r_name||'.example.com') AS my_domain,
       CAST(n_nationkey AS BIGINT) AS target_storage_id, 'storage '||r_name AS target_storage_name,
       'org_'||lower(n_name) AS target_schema, c_name AS target_table, r_name AS instance_name,
       'Edition '||n_regionkey AS org_type, n_regionkey = 0 AS is_sandbox, c_name AS selected_object,
       'Label '||c_custkey AS object_label, p.protocol AS routing_protocol,
       CASE WHEN c_mktsegment='HOUSEHOLD' AND c_acctbal<0 THEN 'RELEASED' WHEN c_acctbal<0 THEN 'FAILED'
            WHEN c_mktsegment='MACHINERY' AND c_acctbal>5000 THEN 'INACTIVE'
            WHEN c_mktsegment='FURNITURE' AND c_acctbal>9000 THEN NULL ELSE 'ACTIVE' END AS routing_status,
       CASE WHEN c_acctbal < -500 THEN 'ERROR' WHEN c_mktsegment='MACHINERY' AND c_acctbal>5000 THEN 'INACTIVE'
            ELSE 'ACTIVE' END AS source_status,
       CAST(NULL AS VARCHAR) AS last_error_message,
       946684800000000 + c_custkey*60000000 AS activated_us, CAST(NULL AS BIGINT) AS released_us,
       946684800000000 + c_custkey*60000000 AS synced_us, 'seed' AS created_by, 'seed' AS updated_by,
       946684800000000 + c_custkey*60000000 AS created_us, 946684800000000 + c_custkey*60000000 AS updated_us,
       c_custkey, c_acctbal, c_mktsegment
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
JOIN (VALUES ('AUTOMOBILE','CDC'),('BUILDING','CDC'),('BUILDING','STREAMING'),('FURNITURE','STREAMING'),
             ('HOUSEHOLD','STREAMING'),('MACHINERY','STREAMING')) p(seg, protocol) ON seg = c_mktsegment
"""


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One route registration per order, in order of the order key."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    org = F.lower(F.concat_ws(".", "n_name", "r_name", F.lit("example.com")))
    urgent = F.col("o_orderpriority").startswith("1")
    return j.select(
        "o_orderkey",
        org.alias("org_key"),
        F.col("n_name").alias("org_name"),
        F.concat(F.lit("https://"), org).alias("my_domain"),
        F.col("n_nationkey").cast("bigint").alias("target_storage_id"),
        F.concat(F.lit("storage "), F.col("r_name")).alias("target_storage_name"),
        F.lit("config").alias("target_schema"),
        F.col("c_name").alias("target_table"),
        F.col("r_name").alias("instance_name"),
        F.lit("-").alias("org_type"),
        F.lit(False).alias("is_sandbox"),
        F.col("c_name").alias("selected_object"),
        F.col("o_orderpriority").alias("object_label"),
        F.when(urgent, "CDC").otherwise("STREAMING").alias("routing_protocol"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("ACTIVE").alias("routing_status"),
        F.lit("ACTIVE").alias("source_status"),
        F.lit(None).cast("string").alias("last_error_message"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate").cast("timestamp")).alias("activated_at"),
        F.lit(None).cast("timestamp").alias("released_at"),
        F.lit(None).cast("timestamp").alias("last_synced_at"),
        F.col("o_orderkey").cast("string").alias("created_by"),
        F.col("o_orderkey").cast("string").alias("updated_by"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slot per route, open while the route is active."""
    return routes(spark, sf_dir).select(
        "org_key", "routing_protocol", "selected_object",
        F.coalesce(F.col("routing_status") == "ACTIVE", F.lit(False)).alias("is_active"),
        "activated_at", F.col("released_at").alias("deactivated_at"), F.lit("seed").alias("note"),
        "created_at", "updated_at",
    )


def now() -> Column:
    """The fixed time the checked queries run at."""
    return utc(F.lit(1_900_000_000_000_000))


NOW_US = 1_900_000_000_000_000


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a catalogue entry; the name carries the key, to be unique."""
    p = table(spark, sf_dir, "part")
    name = F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), F.col("p_partkey").cast("string"))
    return p.select(
        F.col("p_partkey").alias("id"),
        name.alias("name"),
        F.when(F.col("p_size") % 10 == 0, None).otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("label"),
    )


OBJECTS_SQL = """
SELECT p_partkey AS id, replace(p_name,' ','_')||'_'||p_partkey AS name,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type||' '||p_brand END AS label, p_brand, p_partkey FROM part
"""


def object_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every even object: by the count of returned lines, its odd neighbour's included."""
    li = table(spark, sf_dir, "lineitem")
    even = F.col("l_partkey") - F.col("l_partkey") % 2
    returned = li.groupBy(even.alias("even")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n"))
    o = objects(spark, sf_dir)
    joined = o.join(returned, o["id"] == returned["even"])
    return joined.select(
        F.col("name").alias("selected_object"), F.when(F.col("n") % 2 == 0, "STREAMING").otherwise("CDC").alias("status")
    )


STATUSES_SQL = """
SELECT o.name AS selected_object, CASE WHEN count(*) FILTER (l_returnflag='R') % 2 = 0 THEN 'STREAMING' ELSE 'CDC' END AS status
FROM o JOIN lineitem ON o.id = l_partkey - l_partkey % 2 GROUP BY o.name
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its source's folder."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return d.select(
        F.col("source").alias("root"), path.alias("path"),
        F.substring_index(path, "/", -1).alias("file_name"), F.octet_length("text").cast("bigint").alias("size"),
    )


def storage_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    bal = F.col("s_acctbal")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("DB "), F.col("s_name")).alias("name"),
        F.lit("DATABASE").alias("storage_type"),
        F.lit(None).cast("string").alias("description"),
        (bal > 0).alias("enabled"),
        F.when(bal < 1000, "FAILED").when(bal < 4000, "PENDING").otherwise("VERIFIED").alias("connection_status"),
        F.lit(None).cast("boolean").alias("last_test_success"),
        F.lit(None).cast("string").alias("last_error_message"),
        F.lit(None).cast("timestamp").alias("last_tested_at"),
    )


def vendor_of(key: Column) -> Column:
    names = F.array(*[F.lit(v) for v in ("MARIADB", "MYSQL", "ORACLE", "POSTGRESQL")])
    return names[F.pmod(key, F.lit(4)).cast("int")]


def storage_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    vendor = vendor_of(F.col("s_suppkey"))
    half = F.pmod("s_suppkey", F.lit(8)) < 4
    return s.select(
        F.col("s_suppkey").alias("storage_id"),
        vendor.alias("vendor"),
        F.when(F.col("s_acctbal") > 9000, "CERTIFICATE").otherwise("PASSWORD").alias("auth_method"),
        F.concat(F.lower("n_name"), F.lit(".db.example.com")).alias("host"),
        (F.lit(3000) + F.col("s_nationkey")).cast("int").alias("port"),
        F.when(vendor != "ORACLE", F.lower("s_name")).alias("database_name"),
        F.when((vendor == "ORACLE") & half, F.col("s_name")).alias("service_name"),
        F.when((vendor == "ORACLE") & ~half & (F.col("s_acctbal") > 2000), F.lit("XE")).alias("sid"),
        F.when(F.col("s_acctbal") < 3000, F.lit("jdbc:given")).alias("jdbc_url"),
        F.col("s_name").alias("username"),
    )


HEADERS_SQL = """
SELECT s_suppkey AS id, 'DB '||s_name AS name, 'DATABASE' AS storage_type, CAST(NULL AS VARCHAR) AS description,
       s_acctbal > 0 AS enabled,
       CASE WHEN s_acctbal<1000 THEN 'FAILED' WHEN s_acctbal<4000 THEN 'PENDING' ELSE 'VERIFIED' END AS connection_status,
       s_acctbal FROM supplier
"""
DETAILS_SQL = """
SELECT s_suppkey AS storage_id, ['MARIADB','MYSQL','ORACLE','POSTGRESQL'][s_suppkey%4+1] AS vendor,
       CASE WHEN s_acctbal>9000 THEN 'CERTIFICATE' ELSE 'PASSWORD' END AS auth_method,
       lower(n_name)||'.db.example.com' AS host, CAST(3000+s_nationkey AS INT) AS port,
       CASE WHEN s_suppkey%4<>2 THEN lower(s_name) END AS database_name,
       CASE WHEN s_suppkey%4=2 AND s_suppkey%8<4 THEN s_name END AS service_name,
       CASE WHEN s_suppkey%4=2 AND s_suppkey%8>=4 AND s_acctbal>2000 THEN 'XE' END AS sid,
       CASE WHEN s_acctbal<3000 THEN 'jdbc:given' END AS jdbc_url, s_name AS username
FROM supplier JOIN nation ON s_nationkey=n_nationkey
"""


def _quoted(col: Column) -> Column:
    return F.concat(F.lit('"'), col, F.lit('"'))


def _member(name: str, json_value: Column) -> Column:
    """``"name":value``, or null to leave the member out."""
    return F.concat(F.lit(f'"{name}":'), json_value)


def _json_object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


CHANGE_TYPES_BY_EVENT = {"signup": "create", "view": "UNDELETE", "error": "DELETE"}
CHANGE_FIELDS = {"Amount": "currency", "Note": "textarea", "Stage": "string", "LastModifiedDate": "datetime"}


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a nested change record; small values make faulty ones."""
    e = spread(table(spark, sf_dir, "events"))
    kind, value = F.col("event_type"), F.col("value")
    ms = F.floor(micros("ts") / 1000).cast("bigint")
    modified = F.floor(ms / 1000).cast("bigint") - F.pmod("event_id", F.lit(LAG_DAYS)) * 86400
    key = F.lpad(F.col("user_id").cast("string"), 18, "0")
    named = kind != "purchase"
    number = value.cast("string")
    change = F.lit("UPDATE")
    for name, text in CHANGE_TYPES_BY_EVENT.items():
        change = F.when(kind == name, text).otherwise(change)
    change = F.when((value >= 1) & (value < 2), "GAP_CREATE").otherwise(change)
    has_key = ~((value >= 2) & (value < 3))
    changed = (
        F.when(kind == "view", '["0x0600"]').when(kind == "click", '["Amount"]')
        .when(kind == "purchase", '["Deal.Note"," Amount ",null,""]').otherwise("[]")
    )
    header = _json_object(
        _member("recordIds", F.when(named & has_key, F.concat(F.lit("["), _quoted(key), F.lit(',"other"]'))).otherwise("[]")),
        _member("changeType", _quoted(change)),
        F.when(kind != "error", _member("commitTimestamp", ms.cast("string"))),
        _member("changedFields", changed),
        _member("nulledFields", F.when(kind == "purchase", '["Note"]').otherwise("[]")),
    )
    amount = (
        F.when(kind == "click", F.concat(F.lit('{"newValue":'), number, F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"doubleValue":'), number, F.lit("}")))
        .otherwise(number)
    )
    note = F.regexp_replace("props", '"', '\\\\"')
    payload = _json_object(
        F.when(value >= 1, _member("ChangeEventHeader", header)),
        F.when(~named & has_key, _member("Id", _quoted(key))),
        F.when(kind != "error", _member("Amount", amount)),
        F.when(kind != "error", _member("Note", _quoted(note))),
        F.when(
            kind != "error",
            _member("LastModifiedDate", _quoted(F.date_format(F.timestamp_seconds(modified), "yyyy-MM-dd'T'HH:mm:ss'.000+0000'"))),
        ),
        _member("Unknown__c", F.lit("1")),
    )
    wrapped = F.concat(F.lit('{"schema":"s1","payload":'), payload, F.lit("}"))
    return e.select(F.col("event_id").alias("seq"), F.when(kind == "signup", wrapped).otherwise(payload).alias("body"))


CONTACT_FIELDS = {
    "Name": "string", "FirstName": "string", "LastName": "string", "MailingAddress": "textarea",
    "MailingStreet": "string", "MailingCity": "string", "MailingState": "string",
    "MailingPostalCode": "string", "MailingCountry": "string",
}


def contact_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a change of a compound name and address, shaped by its segment."""
    c = spread(table(spark, sf_dir, "customer"))
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    seg = F.col("c_mktsegment")

    def member(name, col):
        return _member(name, _quoted(col))

    full = seg.isin("AUTOMOBILE", "MACHINERY")
    name = (
        F.when(full, _json_object(
            member("Salutation", F.concat(F.lit(" "), seg, F.lit(" "))), member("FirstName", F.col("c_name")),
            member("LastName", F.col("n_name"))))
        .when(seg == "BUILDING", _json_object(member("FirstName", F.col("c_name"))))
        .when(seg == "FURNITURE", _json_object(member("displayValue", F.concat(F.lit("Dr "), F.col("c_name")))))
        .otherwise(_json_object(member("lastName", F.col("n_name"))))
    )
    address = (
        F.when(full, _json_object(
            member("Street", F.col("c_name")), member("City", seg), member("State", F.col("n_name")),
            member("PostalCode", F.col("c_custkey").cast("string")), member("Country", F.col("r_name")),
            _member("Latitude", F.lit("1.5"))))
        .when(seg == "FURNITURE", _json_object(member("City", F.lit("  ")), member("Country", F.col("r_name"))))
    )
    changed = (
        F.when(seg == "AUTOMOBILE", '["0x02","3-0x1F"]').when(seg == "BUILDING", '["Name.FirstName"]')
        .when(seg == "FURNITURE", '["MailingAddress","Name"]').when(seg == "HOUSEHOLD", '["Name"]').otherwise("[]")
    )
    header = _json_object(
        _member("recordIds", F.concat(F.lit('["'), F.col("c_custkey").cast("string"), F.lit('"]'))),
        member("changeType", F.lit("UPDATE")), _member("commitTimestamp", F.lit("1700000000000")),
        _member("changedFields", changed),
        _member("nulledFields", F.when(seg == "MACHINERY", '["MailingCity"]').otherwise("[]")),
    )
    body = _json_object(_member("ChangeEventHeader", header), _member("Name", name), _member("MailingAddress", address))
    return j.select(F.col("c_custkey").alias("seq"), body.alias("body"))


ORDER_FIELDS = {
    "Fiscal": "string", "FiscalYear": "int", "FiscalQuarter": "int", "Amount": "currency", "Stage": "string",
    "LastModifiedDate": "datetime",
}


def _fiscal(day: Column) -> Column:
    year, quarter = F.year(day).cast("string"), F.quarter(day).cast("string")
    whole = F.col("o_orderpriority") != "5-LOW"
    return _json_object(_member("Year", year), F.when(whole, _member("Quarter", F.concat(F.lit('" '), quarter, F.lit('"')))))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a change record with a fiscal period; low priorities lack the quarter."""
    o = spread(table(spark, sf_dir, "orders"))
    header = _json_object(
        _member("recordIds", F.concat(F.lit('["'), F.col("o_orderkey").cast("string"), F.lit('"]'))),
        _member("changeType", F.lit('"UPDATE"')), _member("commitTimestamp", F.lit("1700000000")),
        _member("changedFields", F.when(F.col("o_orderstatus") == "F", '["Stage"]').otherwise('["Fiscal","Amount"]')),
        _member("nulledFields", F.lit('["FiscalYear"]')),
    )
    body = _json_object(
        _member("ChangeEventHeader", header), _member("Fiscal", _fiscal(F.col("o_orderdate"))),
        _member("Amount", F.col("o_totalprice").cast("decimal(12,2)").cast("string")),
        _member("Stage", _quoted(F.col("o_orderstatus"))),
    )
    return o.select(F.col("o_orderkey").alias("seq"), body.alias("body"))


def notice_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a flat notification; its status and priority choose the kind."""
    o = spread(table(spark, sf_dir, "orders"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = (
        F.when(priority == "1-URGENT", "undeleted").when(status == "F", "created").when(status == "O", "Updated").otherwise("DELETED")
    )
    key = F.concat(F.lit("k"), F.col("o_custkey").cast("string"))
    us = micros("o_orderdate")
    stamp = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    delete = kind == "DELETED"
    body = _json_object(
        F.when(delete, _member("Gone", _quoted(key))),
        F.when(~((priority == "2-HIGH") & (status == "F")), _member("Id", F.when(delete, F.lit('"no"')).otherwise(_quoted(key)))),
        _member("sfid", F.lit('"x"')),
        _member("Fiscal", _fiscal(F.col("o_orderdate"))),
        _member("Amount", F.when(priority == "3-MEDIUM", "null").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))),
        _member("LastModifiedDate", _quoted(stamp)),
    )
    return o.select(F.col("o_orderkey").alias("seq"), kind.alias("event_type"), body.alias("body"))
