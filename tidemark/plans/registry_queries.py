"""Checked queries of the route, slot and history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import registry as R
from tidemark.operators.skew import in_order
from tidemark.plans import views as V
from tidemark.plans.checked import query
from tidemark.session import shared_folder

_R = f"WITH r AS ({V.ROUTES_SQL})"
_SHOWN = ["org_key", "selected_object", "routing_protocol", "routing_status", "source_status"]
_COLS = ", ".join(_SHOWN)


def _us(df: DataFrame, *names: str) -> DataFrame:
    """Time columns as microseconds, named ``*_us``."""
    return df.select(
        *[c for c in df.columns if c not in names],
        *[F.unix_micros(c).alias(c.removesuffix("_at").removeprefix("last_") + "_us") for c in names],
    )


def _place(order: str) -> str:
    """SQL for the position in a listing."""
    return f"row_number() OVER (ORDER BY {order}) AS place"


@query(
    "active_routes", "F1 O1 S7",
    f"{_R} SELECT {_COLS}, {_place('org_name, selected_object, routing_protocol, org_key')} FROM r WHERE routing_status='ACTIVE'",
)
def active_routes(spark, sf_dir):
    return in_order(R.active_routes(V.routes(spark, sf_dir)).select(*_SHOWN))


@query(
    "active_routes_of_org", "F1 F3 O1 S7",
    f"""{_R} SELECT {_COLS}, {_place('selected_object, routing_protocol DESC')} FROM r
        WHERE routing_status='ACTIVE' AND source_status='ACTIVE' AND org_key=(SELECT min(org_key) FROM r)""",
)
def active_routes_of_org(spark, sf_dir):
    routes = V.routes(spark, sf_dir)
    org = routes.agg(F.min("org_key")).scalar()
    return in_order(R.both_active(R.active_routes(routes, org), org).select(*_SHOWN))


@query(
    "recoverable_routes", "F2 O1",
    f"""{_R} SELECT {_COLS}, {_place('org_name, selected_object, routing_protocol DESC, org_key')} FROM r
        WHERE coalesce(routing_status,'')<>'RELEASED' AND coalesce(source_status,'')<>'INACTIVE'""",
)
def recoverable_routes(spark, sf_dir):
    return in_order(R.recoverable_routes(V.routes(spark, sf_dir)).select(*_SHOWN))


@query(
    "skipped_routes", "F12",
    f"{_R} SELECT {_COLS} FROM r WHERE upper(source_status)='INACTIVE' OR upper(routing_status) IN ('RELEASED','FAILED')",
)
def skipped_routes(spark, sf_dir):
    return R.skipped(V.routes(spark, sf_dir)).select(*_SHOWN)


@query(
    "route_by_key", "O9 S7",
    f"{_R} SELECT {_COLS} FROM r WHERE (org_key, selected_object, routing_protocol) = "
    "(SELECT min((org_key, selected_object, routing_protocol)) FROM r)",
)
def route_by_key(spark, sf_dir):
    routes = V.routes(spark, sf_dir)
    first = routes.agg(F.min(F.struct(*R.ROUTE_KEY)).alias("k"))
    return R.find_route(routes, *[first.select(f"k.{c}").scalar() for c in R.ROUTE_KEY]).select(*_SHOWN)


_INCOMING = """
, c AS (SELECT o_orderkey, n_name, r_name, c_name, o_orderpriority, o_orderstatus, epoch_us(o_orderdate) AS day_us,
   lower(n_name||'.'||r_name||'.example.com') AS org_key, CASE WHEN o_orderpriority LIKE '1%' THEN 'CDC' ELSE 'STREAMING' END AS protocol
   FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
i AS (SELECT org_key, c_name, protocol, max_by(o_orderpriority, o_orderkey) AS label, max_by(o_orderstatus, o_orderkey) AS st,
   CAST(max(o_orderkey) AS VARCHAR) AS updated_by, CAST(min(o_orderkey) AS VARCHAR) AS created_by,
   min_by(CASE WHEN o_orderstatus='O' THEN day_us ELSE {now} END, o_orderkey) AS act_us FROM c GROUP BY 1,2,3)
"""


#: The routes after every registration was upserted.
UPSERTED_ROUTES = (
    _R + _INCOMING.format(now=V.NOW_US) + f"""
SELECT coalesce(r.org_key, i.org_key) AS org_key, coalesce(selected_object, c_name) AS selected_object,
  coalesce(routing_protocol, protocol) AS routing_protocol, coalesce(i.label, r.object_label) AS object_label,
  CASE WHEN i.org_key IS NULL THEN routing_status WHEN st='F' THEN 'FAILED' ELSE 'ACTIVE' END AS routing_status,
  CASE WHEN i.org_key IS NULL THEN target_schema ELSE 'config' END AS target_schema,
  coalesce(r.created_by, i.created_by) AS created_by, coalesce(i.updated_by, r.updated_by) AS updated_by,
  coalesce(r.activated_us, i.act_us) AS activated_us, CASE WHEN r.org_key IS NULL THEN {V.NOW_US} ELSE created_us END AS created_us,
  CASE WHEN i.org_key IS NULL THEN updated_us ELSE {V.NOW_US} END AS updated_us,
  CASE WHEN i.org_key IS NULL THEN synced_us ELSE {V.NOW_US} END AS synced_us
FROM r FULL OUTER JOIN i ON r.org_key=i.org_key AND selected_object=c_name AND routing_protocol=protocol"""
)


def upserted_columns(out: DataFrame) -> DataFrame:
    out = out.select(
        *R.ROUTE_KEY, "object_label", "routing_status", "target_schema", "created_by", "updated_by",
        "activated_at", "created_at", "updated_at", "last_synced_at",
    )
    return _us(out, "activated_at", "created_at", "updated_at", "last_synced_at")


@query("upsert_routes", "K11 S10 J3", UPSERTED_ROUTES)
def upsert_routes(spark, sf_dir):
    return upserted_columns(R.upsert_routes(V.routes(spark, sf_dir), V.registrations(spark, sf_dir), V.now(), order="o_orderkey"))


@query(
    "upsert_slots", "K12",
    _R + _INCOMING.format(now=V.NOW_US) + f"""
SELECT coalesce(r.org_key, i.org_key) AS org_key, coalesce(selected_object, c_name) AS selected_object,
  coalesce(routing_protocol, protocol) AS routing_protocol,
  CASE WHEN i.org_key IS NOT NULL THEN true ELSE coalesce(routing_status='ACTIVE', false) END AS is_active,
  CASE WHEN i.org_key IS NULL THEN 'seed' ELSE label END AS note, coalesce(r.activated_us, {V.NOW_US}) AS activated_us,
  CASE WHEN i.org_key IS NULL THEN updated_us ELSE {V.NOW_US} END AS updated_us
FROM r FULL OUTER JOIN i ON r.org_key=i.org_key AND selected_object=c_name AND routing_protocol=protocol""",
)
def upsert_slots(spark, sf_dir):
    new = V.registrations(spark, sf_dir).select("o_orderkey", *R.ROUTE_KEY, F.col("object_label").alias("note"))
    out = R.upsert_slots(V.slots(spark, sf_dir), new, V.now(), order="o_orderkey")
    return _us(out.drop("deactivated_at", "created_at"), "activated_at", "updated_at")


def _changes(spark, sf_dir) -> DataFrame:
    """A status change for the routes of every even customer: by the last order, its odd neighbour's included."""
    o = V.table(spark, sf_dir, "orders")
    even = F.col("o_custkey") - F.col("o_custkey") % 2
    last = o.groupBy(even.alias("even")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.max("o_orderkey").alias("ok"))
    c = V.table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("even"))
    to = F.when(F.col("s") == "F", "FAILED").when(F.col("s") == "O", "RECOVERED").otherwise("RELEASED")
    named = c.select(F.col("c_name").alias("selected_object"), to.alias("to"), F.col("ok").cast("string").alias("message"))
    keys = V.routes(spark, sf_dir).select(*R.ROUTE_KEY)
    return keys.join(named, "selected_object").withColumns({"actor": F.lit("ops"), "note": F.col("message")})


_CHANGES = """
, ch AS (SELECT c_name, max_by(o_orderstatus, o_orderkey) AS s, CAST(max(o_orderkey) AS VARCHAR) AS msg FROM orders
         JOIN customer ON o_custkey - o_custkey % 2 = c_custkey GROUP BY c_name)
"""


@query(
    "route_transitions", "K13",
    _R + _CHANGES + f"""
SELECT org_key, selected_object, routing_protocol,
  CASE s WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'RELEASED' ELSE routing_status END AS routing_status,
  CASE s WHEN 'F' THEN 'ERROR' WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'INACTIVE' ELSE source_status END AS source_status,
  CASE WHEN s IN ('F','P') THEN msg END AS last_error_message, CASE WHEN s='P' THEN {V.NOW_US} END AS released_us,
  CASE WHEN s IS NULL THEN synced_us ELSE {V.NOW_US} END AS synced_us, CASE WHEN s IS NULL THEN 'seed' ELSE 'ops' END AS updated_by
FROM r LEFT JOIN ch ON selected_object = c_name""",
)
def route_transitions(spark, sf_dir):
    out = R.transition(V.routes(spark, sf_dir), _changes(spark, sf_dir), V.now())
    return _us(out.select(*_SHOWN, "last_error_message", "released_at", "last_synced_at", "updated_by"), "released_at", "last_synced_at")


@query(
    "route_history", "S11 K13",
    _R + _CHANGES + f"""
SELECT org_key, selected_object, routing_protocol, CASE s WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RECOVERED' ELSE 'RELEASED' END AS event_type,
  routing_status AS status_before, CASE s WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'ACTIVE' ELSE 'RELEASED' END AS status_after,
  msg AS message, 'ops' AS actor, {V.NOW_US} AS event_us
FROM r JOIN ch ON selected_object = c_name""",
)
def route_history(spark, sf_dir):
    """The events of a batch of status changes, appended to the history table and read back."""
    events = R.transition_events(V.routes(spark, sf_dir), _changes(spark, sf_dir), V.now())
    path = shared_folder(spark, "history")
    R.append_history(events, path)
    return _us(spark.read.parquet(path), "event_at")


def _slot_sql(all_orgs: bool) -> str:
    hit = "msg IS NOT NULL" if all_orgs else "msg IS NOT NULL AND coalesce(routing_status='ACTIVE', false)"
    note = "'seed'" if all_orgs else f"CASE WHEN {hit} THEN msg ELSE 'seed' END"
    return _R + _CHANGES + f"""
SELECT org_key, selected_object, routing_protocol, NOT ({hit}) AND coalesce(routing_status='ACTIVE', false) AS is_active, {note} AS note,
  CASE WHEN {hit} THEN {V.NOW_US} END AS deactivated_us FROM r LEFT JOIN ch ON selected_object = c_name"""


@query("deactivate_slots", "K14", _slot_sql(False))
def deactivate_slots(spark, sf_dir):
    out = R.deactivate_slots(V.slots(spark, sf_dir), _changes(spark, sf_dir), V.now())
    return _us(out.select(*R.ROUTE_KEY, "is_active", "note", "deactivated_at"), "deactivated_at")


@query("deactivate_slots_of_all_orgs", "K14", _slot_sql(True))
def deactivate_slots_of_all_orgs(spark, sf_dir):
    out = R.deactivate_slots(V.slots(spark, sf_dir), _changes(spark, sf_dir), V.now(), match_org=False)
    return _us(out.select(*R.ROUTE_KEY, "is_active", "note", "deactivated_at"), "deactivated_at")


@query(
    "release_unsynced_routes", "K15",
    _R + f""", s AS (SELECT org_key, my_domain, avg(synced_us)::BIGINT AS at_us FROM r WHERE is_sandbox GROUP BY 1,2)
SELECT r.org_key, selected_object, routing_protocol, CASE WHEN synced_us < at_us THEN 'RELEASED' ELSE routing_status END AS routing_status,
  CASE WHEN synced_us < at_us THEN 'not seen' END AS last_error_message, CASE WHEN synced_us < at_us THEN {V.NOW_US} ELSE synced_us END AS synced_us
FROM r LEFT JOIN s ON r.org_key=s.org_key AND r.my_domain=s.my_domain""",
)
def release_unsynced_routes(spark, sf_dir):
    routes = V.routes(spark, sf_dir)
    # The times of ten thousand routes add up to more than 64 bits.
    total = F.sum(F.unix_micros("last_synced_at").cast("decimal(20,0)"))
    mean = F.round(total / F.count(F.lit(1))).cast("bigint")
    syncs = routes.where("is_sandbox").groupBy("org_key", "my_domain").agg(F.timestamp_micros(mean).alias("synced_at"))
    out = R.release_unsynced(routes, syncs, V.now(), "not seen")
    return _us(out.select(*R.ROUTE_KEY, "routing_status", "last_error_message", "last_synced_at"), "last_synced_at")


@query(
    "default_org", "K19",
    f"{_R} SELECT DISTINCT org_key, org_key = (SELECT max(org_key) FROM r) AS is_default FROM r",
)
def default_org(spark, sf_dir):
    orgs = V.routes(spark, sf_dir).select("org_key").distinct()
    return R.set_default(orgs, orgs.agg(F.max("org_key")).scalar())


@query(
    "first_org_becomes_default", "K19",
    f"{_R} SELECT DISTINCT org_key, NOT is_sandbox AND org_key = (SELECT min(org_key) FROM r WHERE NOT is_sandbox) AS is_default FROM r",
)
def first_org_becomes_default(spark, sf_dir):
    orgs = V.routes(spark, sf_dir).select("org_key", "is_sandbox").distinct()
    old = orgs.where("is_sandbox").select("org_key", F.lit(False).alias("is_default"))
    return R.default_for_first(old, orgs.where("NOT is_sandbox").select("org_key"))


@query(
    "merge_attributes", "K20",
    """SELECT c_custkey, CASE WHEN s IN ('F','O') THEN s||o_key ELSE c_name END AS name, c_mktsegment AS segment FROM customer
       LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s, max(o_orderkey) AS o_key FROM orders GROUP BY 1) ON o_custkey=c_custkey""",
)
def merge_attributes(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    o = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.max("o_orderkey").cast("string").alias("k")
    )
    new = o.select(
        "c_custkey", F.when(F.col("s") == "P", "  ").otherwise(F.concat("s", "k")).alias("name"), F.lit(None).cast("string").alias("segment")
    )
    return R.merge_attributes(c, new, "c_custkey")


@query(
    "merge_attributes_in_order", "K20",
    """SELECT c_custkey, coalesce(s, c_name) AS name, coalesce(p, c_mktsegment) AS segment FROM customer
       LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus||o_orderkey, o_orderkey) FILTER (o_orderstatus <> 'P') AS s,
         max_by(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS p FROM orders GROUP BY 1) ON o_custkey=c_custkey""",
)
def merge_attributes_in_order(spark, sf_dir):
    """Every order as an update of its customer: several of one key, some of them blank or null."""
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    status, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    new = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(status == "P", "  ").otherwise(F.concat(status, key)).alias("name"),
        F.when(status == "O", F.col("o_orderpriority")).alias("segment"),
    )
    return R.merge_attributes(c, new, "c_custkey", order="o_orderkey")


# -- lookups ----------------------------------------------------------------------------


@query(
    "matched_objects", "J4",
    f"""{_R} SELECT selected_object, 'cdc' AS routing_protocol FROM (SELECT c_name AS selected_object FROM customer)
        WHERE selected_object IN (SELECT selected_object FROM r WHERE routing_status='ACTIVE' AND routing_protocol='CDC')""",
)
def matched_objects(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    wanted = c.select(F.col("c_name").alias("selected_object"), F.lit("cdc").alias("routing_protocol"))
    return R.matched_objects(wanted, V.routes(spark, sf_dir))


@query(
    "route_details", "J7 S8",
    f"""{_R}, n AS (SELECT c_name AS t, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1)
        SELECT org_key, selected_object, routing_protocol, coalesce(n, 0) AS synced_record_count, coalesce(n, 0) = 0 AS record_count_warning,
          CASE WHEN c_acctbal > 0 THEN 'Amount,Id,Name' ELSE '' END AS fields, c_acctbal <= 0 AS field_load_warning
        FROM r LEFT JOIN n ON t = target_table""",
)
def route_details(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    o = V.table(spark, sf_dir, "orders")
    counts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_name").alias("target_table")).agg(F.count(F.lit(1)).alias("n"))
    fields = c.where("c_acctbal > 0").select(
        F.col("c_name").alias("selected_object"), F.explode(F.array(F.lit("Name"), F.lit("Id"), F.lit("Amount"))).alias("name")
    )
    out = R.route_detail(V.routes(spark, sf_dir), counts, fields)
    return out.withColumn("fields", F.array_join("fields", ",")).drop("target_table")


@query(
    "option_lookup", "J8",
    """SELECT o_orderkey, s_name AS option_name, CASE WHEN s_suppkey IS NULL THEN 'no_option' END AS reject_reason
       FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey""",
)
def option_lookup(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return R.option_lookup(o, s, "o_custkey", "s_suppkey").drop("o_custkey")


# -- aggregates -------------------------------------------------------------------------


@query("active_slot_count", "A1", f"{_R} SELECT count(*) AS used FROM r WHERE routing_status='ACTIVE' AND routing_protocol='CDC'")
def active_slot_count(spark, sf_dir):
    return R.active_slot_count(V.slots(spark, sf_dir), "CDC")


@query("slot_summary", "A2", f'{_R} SELECT count(*) AS used, 5 AS "limit" FROM r WHERE routing_status=\'ACTIVE\'')
def slot_summary(spark, sf_dir):
    return R.slot_summary(V.slots(spark, sf_dir))


@query(
    "slot_availability", "A3",
    f"""{_R} SELECT count(*) AS used, 5 AS "limit", greatest(5-count(*), 0) AS available FROM r
        WHERE routing_status='ACTIVE' AND routing_protocol='STREAMING'""",
)
def slot_availability(spark, sf_dir):
    return R.slot_availability(V.slots(spark, sf_dir), "STREAMING")


@query(
    "orgs_grouped", "A4",
    f"""{_R} SELECT org_key, max(org_name) AS org_name, max(instance_name) AS instance_name, max(org_type) AS org_type,
        bool_or(is_sandbox) AS is_sandbox, max(my_domain) AS my_domain, {_place('max(org_name), org_key')}
        FROM r WHERE routing_status='ACTIVE' GROUP BY org_key""",
)
def orgs_grouped(spark, sf_dir):
    return in_order(R.orgs_grouped(V.routes(spark, sf_dir)))


@query(
    "orgs_distinct", "A5",
    f"""{_R} SELECT *, {_place('org_name, org_key, my_domain, target_storage_id, target_storage_name, target_schema, instance_name, org_type, is_sandbox')}
        FROM (SELECT DISTINCT org_key, org_name, my_domain, target_storage_id, target_storage_name, target_schema, instance_name,
        org_type, is_sandbox FROM r WHERE routing_status='ACTIVE')""",
)
def orgs_distinct(spark, sf_dir):
    return in_order(R.orgs_distinct(V.routes(spark, sf_dir)))


@query(
    "dashboard_counts", "A6",
    f"""{_R} SELECT count(*) AS active_route_count, count(DISTINCT org_key) AS active_org_count,
        count(*) FILTER (routing_protocol='STREAMING') AS streaming_count, count(*) FILTER (routing_protocol='CDC') AS cdc_count
        FROM r WHERE routing_status='ACTIVE'""",
)
def dashboard_counts(spark, sf_dir):
    return R.dashboard_counts(V.routes(spark, sf_dir))


@query(
    "first_org", "A7",
    f"""{_R} SELECT org_key, max(org_name) AS org_name, max(instance_name) AS instance_name, max(org_type) AS org_type,
        bool_or(is_sandbox) AS is_sandbox, max(my_domain) AS my_domain FROM r WHERE routing_status='ACTIVE'
        GROUP BY org_key ORDER BY org_name, org_key LIMIT 1""",
)
def first_org(spark, sf_dir):
    return R.first_org(R.orgs_grouped(V.routes(spark, sf_dir)))


@query(
    "status_by_object", "A12",
    f"{_R} SELECT selected_object, max(routing_protocol) AS status FROM r WHERE routing_status='ACTIVE' GROUP BY 1",
)
def status_by_object(spark, sf_dir):
    return R.status_by_object(V.routes(spark, sf_dir))


@query(
    "recovery_outcomes", "A15 K13",
    f"""{_R} SELECT CASE WHEN c_acctbal > 8000 THEN 'skipped' WHEN NOT (org_type <> 'Edition 2') THEN 'failed' ELSE 'recovered' END AS outcome,
        count(*) AS n FROM r WHERE coalesce(routing_status,'')<>'RELEASED' AND coalesce(source_status,'')<>'INACTIVE' GROUP BY 1""",
)
def recovery_outcomes(spark, sf_dir):
    routes = V.routes(spark, sf_dir)
    rich = V.table(spark, sf_dir, "customer").where("c_acctbal > 8000").select(F.col("c_name").alias("selected_object"))
    running = routes.join(rich, "selected_object", "left_semi")
    known = routes.where("org_type <> 'Edition 2'")
    return R.outcome_counts(R.recovery_outcomes(routes, running, known))


@query(
    "restarts_per_org", "A16",
    f"""{_R}, q AS (SELECT DISTINCT org_key FROM r)
        SELECT q.org_key, count(r.org_key) AS restarted_count, CASE WHEN count(r.org_key)=0 THEN 'NOT_FOUND' ELSE 'SUCCESS' END AS status
        FROM q LEFT JOIN r ON r.org_key=q.org_key AND routing_status='ACTIVE' AND routing_protocol='CDC' AND c_acctbal > 9500 GROUP BY 1""",
)
def restarts_per_org(spark, sf_dir):
    routes = V.routes(spark, sf_dir)
    rich = V.table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_name").alias("selected_object"))
    restarted = routes.where("routing_status = 'ACTIVE' AND routing_protocol = 'CDC'").join(rich, "selected_object", "left_semi")
    return R.restarts_per_org(routes.select("org_key").distinct(), restarted)


@query(
    "route_defaults", "P25 C10 C22",
    """SELECT c_custkey, CASE WHEN c_acctbal<0 THEN 'default-org' WHEN c_acctbal<3000 THEN 'host'||c_custkey||'.example.com'
           ELSE lower(c_name) END AS org_key,
         CASE WHEN c_mktsegment='BUILDING' THEN 'Org '||c_custkey WHEN c_acctbal<0 OR c_acctbal>=6000 THEN '-'
              ELSE 'host'||c_custkey||'.example.com' END AS org_name,
         'config' AS target_schema, c_name AS target_table, c_name AS object_label, '-' AS org_type,
         CASE WHEN c_mktsegment='MACHINERY' THEN 'ACTIVE' ELSE 'UNKNOWN' END AS routing_status, 'UNKNOWN' AS source_status FROM customer""",
)
def route_defaults(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    bal, key = F.col("c_acctbal"), F.col("c_custkey").cast("string")
    none = F.lit(None).cast("string")
    raw = c.select(
        F.when(bal >= 3000, F.col("c_name")).when(bal < 0, " ").alias("org_key"),
        F.when((bal >= 0) & (bal < 6000), F.concat(F.lit("https://host"), key, F.lit(".example.com/x"))).alias("instance_url"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Org "), key)).alias("org_name"),
        none.alias("target_schema"), F.lit(" ").alias("target_table"), none.alias("instance_name"), none.alias("org_type"),
        F.col("c_name").alias("selected_object"), F.lit("").alias("object_label"), F.lit("CDC").alias("routing_protocol"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "ACTIVE").alias("routing_status"), none.alias("source_status"),
    )
    out = R.route_defaults(raw)
    number = F.regexp_extract("selected_object", "([0-9]+)$", 1).cast("bigint")
    return out.select(
        number.alias("c_custkey"), "org_key", "org_name", "target_schema", "target_table", "object_label", "org_type",
        "routing_status", "source_status",
    )
