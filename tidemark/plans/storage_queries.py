"""Checked queries of the storage registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import storage as S
from tidemark.operators.registry import append_history
from tidemark.operators.skew import in_order
from tidemark.plans import views as V
from tidemark.plans.checked import query
from tidemark.session import shared_folder

_W = f"WITH h AS ({V.HEADERS_SQL}), d AS ({V.DETAILS_SQL}), j AS (SELECT * FROM h JOIN d ON storage_id=id)"
_SHOWN = ["id", "name", "storage_type", "connection_status", "vendor", "auth_method", "username"]
_COLS = ", ".join(_SHOWN)


def _storages(spark, sf_dir) -> DataFrame:
    return S.joined(V.storage_headers(spark, sf_dir), V.storage_details(spark, sf_dir))


@query("storages_joined", "J1", f"{_W} SELECT {_COLS} FROM j")
def storages_joined(spark, sf_dir):
    return _storages(spark, sf_dir).select(*_SHOWN)


_SORTS = {
    "id": "id", "name": "name", "vendor": "vendor", "status": "connection_status", "authType": "auth_method",
    "storageType": "storage_type", "colour": "id",
}


def _listing_query(sort: str, column: str, direction: str) -> None:
    @query(
        f"storage_page_{sort.lower()}_{direction.lower()}", "O8",
        f"{_W} SELECT {_COLS} FROM j ORDER BY {column} {direction}, id LIMIT 20 OFFSET 20",
    )
    def run(spark, sf_dir):
        return S.listing(_storages(spark, sf_dir), 1, 0, sort, direction).select(*_SHOWN)


for _sort, _column in _SORTS.items():
    for _direction in ("ASC", "DESC"):
        _listing_query(_sort, _column, _direction)


@query("storage_options", "F9", f"{_W} SELECT id, name, connection_status, vendor, row_number() OVER (ORDER BY name, id) AS place FROM j WHERE enabled")
def storage_options(spark, sf_dir):
    return in_order(S.options(_storages(spark, sf_dir)).select("id", "name", "connection_status", "vendor"))


@query("storage_totals", "A13", f"{_W} SELECT count(*) AS total, CAST(ceil(count(*)/100.0) AS BIGINT) AS pages FROM j")
def storage_totals(spark, sf_dir):
    return S.totals(_storages(spark, sf_dir), 500)


_VENDOR = "['MARIADB','MYSQL','ORACLE','POSTGRESQL'][c_custkey%4+1]"


def _registrations(spark, sf_dir) -> DataFrame:
    """A storage registration per customer, many of them faulty."""
    c = V.table(spark, sf_dir, "customer")
    bal, seg, k = F.col("c_acctbal"), F.col("c_mktsegment"), F.pmod("c_custkey", F.lit(11))
    none = F.lit(None).cast("string")
    return c.select(
        "c_custkey",
        F.when(k != 0, V.vendor_of(F.col("c_custkey"))).alias("vendor"),
        F.when(k != 1, F.when(seg == "BUILDING", "CERTIFICATE").otherwise("PASSWORD")).alias("auth_method"),
        F.when(k == 2, " ").otherwise("db.example.com").alias("raw_url"),
        F.when(k == 3, 0).when(k != 4, F.lit(3306)).cast("int").alias("port"),
        F.when(k == 5, none).otherwise(F.col("c_name")).alias("name"),
        F.when(bal > 3000, "config").alias("schema_name"),
        F.when((bal > 0) & (bal < 8000), "etl").alias("username"),
        F.when(k != 6, "x").alias("password"),
        F.when(k != 7, "/t").alias("trust_store_path"), F.lit("p").alias("trust_store_password"),
        F.when(k != 8, "/k").otherwise(" ").alias("key_store_path"), F.lit("p").alias("key_store_password"),
    )


@query(
    "registration_checks", "F11",
    f"""SELECT c_custkey, CASE WHEN k=0 THEN 'vendor' WHEN k=1 THEN 'auth_method' WHEN k=2 THEN 'raw_url' WHEN k=3 THEN 'port'
          WHEN k=5 THEN 'name' WHEN {_VENDOR}='ORACLE' AND c_acctbal<=3000 AND NOT (c_acctbal>0 AND c_acctbal<8000) THEN 'schema_context'
          WHEN c_mktsegment<>'BUILDING' AND NOT (c_acctbal>0 AND c_acctbal<8000) THEN 'username'
          WHEN c_mktsegment<>'BUILDING' AND k=6 THEN 'password' WHEN c_mktsegment='BUILDING' AND k=7 THEN 'trust_store_path'
          WHEN c_mktsegment='BUILDING' AND k=8 THEN 'key_store_path' END AS reject_reason
        FROM (SELECT *, c_custkey%11 AS k FROM customer)""",
)
def registration_checks(spark, sf_dir):
    return S.validate(_registrations(spark, sf_dir)).select("c_custkey", "reject_reason")


_FORMS = (
    ("POSTGRESQL", "jdbc:postgresql://{h}:5433/appdb"), ("MARIADB", "jdbc:mariadb://{h}"),
    ("MYSQL", "{h}:3307/shop?useSSL=true#f"), ("ORACLE", "jdbc:oracle:thin:@{h}:1521:XE"),
    ("ORACLE", "jdbc:oracle:thin:@//{h}:1522/svc"), ("ORACLE", " {h} "),
    ("MYSQL", "<http://{h}:3306/shop|db link>"), ("POSTGRESQL", "https://{h}/path/"),
    ("MYSQL", ""), ("MARIADB", "mariadb://bad host!!"),
)


def _addressed(spark, sf_dir) -> DataFrame:
    """A connection string of ten forms per customer."""
    c = V.table(spark, sf_dir, "customer")
    k = F.pmod("c_custkey", F.lit(len(_FORMS))).cast("int")
    forms = F.array(*[F.lit(f) for _, f in _FORMS])
    vendors = F.array(*[F.lit(v) for v, _ in _FORMS])
    host = F.concat(F.lit("db"), F.col("c_custkey").cast("string"), F.lit(".example.com"))
    named = F.when(F.col("c_acctbal") > 5000, F.concat(F.col("c_mktsegment"), F.lit(" -No"), F.col("c_custkey").cast("string"), F.lit("!")))
    return c.select(
        "c_custkey", vendors[k].alias("vendor"), F.replace(forms[k], F.lit("{h}"), host).alias("raw_url"),
        F.when(F.col("c_acctbal") < 0, 9999).cast("int").alias("port"),
        named.alias("schema_name"), F.when(F.col("c_acctbal") > 7000, "etl_user").alias("username"),
    )


@query(
    "storage_addresses", "C16 C17",
    """WITH k AS (SELECT *, c_custkey%10 AS k, 'db'||c_custkey||'.example.com' AS h, CASE WHEN c_acctbal<0 THEN 9999 END AS given,
                    CASE WHEN c_acctbal>5000 THEN c_mktsegment||' -No'||c_custkey||'!' END AS sn FROM customer),
       p AS (SELECT c_custkey, k, h, sn, c_acctbal, coalesce(given, [5433,3306,3307,1521,1522,1521,3306,5432][k+1]) AS port,
               CASE k WHEN 0 THEN 'appdb' WHEN 2 THEN 'shop' WHEN 6 THEN 'shop' WHEN 7 THEN 'path' END AS db,
               CASE k WHEN 4 THEN 'svc' WHEN 5 THEN sn END AS svc, CASE k WHEN 3 THEN 'XE' END AS sid FROM k),
       g AS (SELECT *, k < 8 AS ok FROM p)
       SELECT c_custkey, CASE WHEN ok THEN h END AS host, CASE WHEN ok THEN CAST(port AS INT) END AS port, db AS database_name,
         svc AS service_name, sid,
         CASE WHEN NOT ok THEN NULL WHEN k=0 OR k=7 THEN 'jdbc:postgresql://'||h||':'||port||'/'||db
              WHEN k=1 THEN 'jdbc:mariadb://'||h||':'||port WHEN k IN (2,6) THEN 'jdbc:mysql://'||h||':'||port||'/'||db
              WHEN k=3 THEN 'jdbc:oracle:thin:@'||h||':'||port||':XE'
              ELSE 'jdbc:oracle:thin:@//'||h||':'||port||coalesce('/'||svc,'') END AS jdbc_url,
         CASE WHEN k BETWEEN 3 AND 5 THEN CASE WHEN c_acctbal>7000 THEN 'ETL_USER' ELSE upper(sn) END
              ELSE 'org_'||replace(replace(lower(replace(sn,'!','')),' -','_'),'__','_') END AS schema_name,
         CASE WHEN NOT ok THEN 'address' END AS address_reject FROM g""",
)
def storage_addresses(spark, sf_dir):
    return S.normalize(_addressed(spark, sf_dir)).drop("vendor", "raw_url", "username")


def _tests(spark, sf_dir) -> DataFrame:
    """A connection test per event, of every second storage."""
    return V.table(spark, sf_dir, "events").select(
        (2 * F.col("user_id")).alias("id"), (F.col("event_type") != "error").alias("success"), F.col("props").alias("message"),
        F.col("ts").cast("timestamp").alias("tested_at"),
    )


_EDITS = "SELECT 2 * c_custkey AS id, c_name AS name, c_mktsegment AS description FROM customer"


@query(
    "storage_edits", "K16",
    f"""{_W}, e AS ({_EDITS}) SELECT h.id, CASE WHEN e.id IS NULL THEN h.name ELSE e.name END AS name,
        CASE WHEN e.id IS NULL THEN h.description ELSE e.description END AS description,
        CASE WHEN e.id IS NULL THEN connection_status ELSE 'PENDING' END AS connection_status FROM h LEFT JOIN e ON e.id=h.id""",
)
def storage_edits(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    edits = c.select((2 * F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))
    return S.edit(V.storage_headers(spark, sf_dir), edits).select("id", "name", "description", "connection_status")


@query(
    "storage_test_results", "K16",
    f"""{_W}, t AS (SELECT 2 * user_id AS id, max_by(event_type, ts) AS kind, max_by(props, ts) AS message, max(epoch_us(ts)) AS us FROM events GROUP BY 1)
        SELECT h.id, CASE WHEN t.id IS NULL THEN connection_status WHEN kind<>'error' THEN 'VERIFIED' ELSE 'FAILED' END AS connection_status,
          kind<>'error' AS last_test_success, CASE WHEN kind='error' THEN message END AS last_error_message, us AS tested_us
        FROM h LEFT JOIN t ON t.id=h.id""",
)
def storage_test_results(spark, sf_dir):
    out = S.record_tests(V.storage_headers(spark, sf_dir), _tests(spark, sf_dir))
    return out.select("id", "connection_status", "last_test_success", "last_error_message", F.unix_micros("last_tested_at").alias("tested_us"))


@query(
    "storage_test_history", "S14",
    f"""{_W} SELECT 2 * user_id AS id, 'TEST' AS kind, event_type<>'error' AS success, CASE WHEN event_type='error' THEN props END AS message,
          epoch_us(ts) AS tested_us FROM events WHERE 2 * user_id IN (SELECT id FROM h)""",
)
def storage_test_history(spark, sf_dir):
    """One history row per connection test, appended in two batches and read back."""
    path = shared_folder(spark, "history")
    tests, headers = _tests(spark, sf_dir), V.storage_headers(spark, sf_dir)
    for batch in (F.coalesce("success", F.lit(False)), ~F.coalesce("success", F.lit(False))):
        append_history(S.test_events(headers, tests.where(batch)), path)
    return spark.read.parquet(path).select("id", "kind", "success", "message", F.unix_micros("tested_at").alias("tested_us"))


@query(
    "cascade_deletes", "K17 J5",
    "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)",
)
def cascade_deletes(spark, sf_dir):
    gone = V.storage_headers(spark, sf_dir).join(
        V.table(spark, sf_dir, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("id")), "id", "left_semi"
    )
    children = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return S.cascade_delete(gone, children, "l_suppkey")


@query(
    "backfilled_urls", "K18",
    f"""{_W} SELECT storage_id, coalesce(jdbc_url, CASE WHEN vendor IN ('MARIADB','MYSQL','POSTGRESQL')
            THEN 'jdbc:'||lower(vendor)||'://'||host||':'||port||'/'||coalesce(database_name,'')
          WHEN service_name IS NOT NULL THEN 'jdbc:oracle:thin:@//'||host||':'||port||'/'||service_name
          WHEN sid IS NOT NULL THEN 'jdbc:oracle:thin:@'||host||':'||port||':'||sid END) AS jdbc_url FROM d""",
)
def backfilled_urls(spark, sf_dir):
    return S.backfill_url(V.storage_details(spark, sf_dir)).select("storage_id", "jdbc_url")
