"""Route, slot and history tables: upserts, status changes and dashboard queries.

(K11-K15, K19, K20, A1-A7, A12, A15, A16, F1-F3, F12, J2, J4, J7, J8, O1, O9, P25, S7, S11.)
``now`` is a parameter everywhere, so that a rerun gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.columns import strip
from tidemark.functions.naming import first_non_blank, non_blank, org_key

# Keys of the two tables, statuses, the slot limit.
ROUTE_KEY = ("org_key", "selected_object", "routing_protocol")
SLOT_KEY = ("org_key", "routing_protocol", "selected_object")
SLOT_LIMIT = 5
PROTOCOLS = ("STREAMING", "CDC")
TRANSITIONS = {
    "RELEASED": {"routing_status": "RELEASED", "source_status": "INACTIVE"},
    "FAILED": {"routing_status": "FAILED", "source_status": "ERROR"},
    "RECOVERED": {"routing_status": "ACTIVE", "source_status": "ACTIVE"},
}


# -- rows ------------------------------------------------------------------------------


def url_host(url: Column) -> Column:
    """Host of an address, '-' when blank."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(strip(F.coalesce(url, F.lit(""))) == "", "-").otherwise(F.when(host != "", host))


def route_defaults(raw: DataFrame) -> DataFrame:
    """Registry rows from registration properties, blanks replaced by defaults (P25)."""
    key = org_key(first_non_blank(F.col("org_key"), F.col("instance_url"), F.lit("default-org")))
    key = F.when(key == "", "default-org").otherwise(key)
    host = url_host(F.col("instance_url"))
    obj = F.coalesce("selected_object", F.lit(""))
    return raw.select(
        key.alias("org_key"),
        first_non_blank(F.col("org_name"), host, key).alias("org_name"),
        F.col("instance_url").alias("my_domain"),
        first_non_blank(F.col("target_schema"), default="config").alias("target_schema"),
        first_non_blank(F.col("target_table"), obj).alias("target_table"),
        first_non_blank(F.col("instance_name"), host).alias("instance_name"),
        first_non_blank(F.col("org_type")).alias("org_type"),
        obj.alias("selected_object"),
        first_non_blank(F.col("object_label"), obj).alias("object_label"),
        F.col("routing_protocol"),
        first_non_blank(F.col("routing_status"), default="UNKNOWN").alias("routing_status"),
        first_non_blank(F.col("source_status"), default="UNKNOWN").alias("source_status"),
    )


def last_per_key(rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """The last row of every key, by ``order`` or as the rows come."""
    numbered = rows.withColumn("_order", F.col(order) if order else F.monotonically_increasing_id())
    values = [c for c in rows.columns if c not in keys]
    last = numbered.groupBy(*keys).agg(F.max_by(F.struct(*values), "_order").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    keep: Sequence[str] = (),
    order: str | None = None,
) -> DataFrame:
    """Insert or update by key; ``keep`` columns survive an update.

    Several incoming rows may share a key: the first one (by ``order``, or as they come)
    inserts, the last one sets the rest. Rows with a null in their key never match, as in a unique index.
    """
    columns = stored.columns
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    loose = incoming.where(~whole).select(*columns)
    incoming = incoming.where(whole)
    values = [c for c in columns if c not in keys]
    first = [c for c in values if c in keep]
    incoming = incoming.withColumn("_order", F.col(order) if order else F.monotonically_increasing_id())
    by_key = incoming.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "_order").alias("_last"), *([F.min_by(F.struct(*first), "_order").alias("_first")] if first else [])
    )
    old = stored.withColumn("_stored", F.lit(True)).alias("o")
    new = by_key.withColumn("_incoming", F.lit(True)).alias("n")
    same = reduce(lambda a, b: a & b, (F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys))

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        if c in keep:
            return F.when(F.col("_stored"), F.col(f"o.{c}")).otherwise(F.col(f"_first.{c}"))
        return F.when(F.col("_incoming"), F.col(f"_last.{c}")).otherwise(F.col(f"o.{c}"))

    joined = old.join(new, same, "full_outer")
    return joined.select(*[value(c).alias(c) for c in columns]).unionByName(loose)


def upsert_routes(routes: DataFrame, incoming: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Register routes; first activation and creation survive."""
    stamped = incoming.withColumns(
        {
            "activated_at": F.coalesce("activated_at", now),
            "last_synced_at": F.coalesce("last_synced_at", now),
            "created_at": now,
            "updated_at": now,
        }
    )
    return upsert(routes, stamped, ROUTE_KEY, ("activated_at", "created_by", "created_at"), order)


def upsert_slots(slots: DataFrame, incoming: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Activate slots; the first activation time survives."""
    stamped = incoming.withColumns(
        {
            "is_active": F.lit(True),
            "activated_at": now,
            "deactivated_at": F.lit(None).cast("timestamp"),
            "created_at": now,
            "updated_at": now,
        }
    )
    return upsert(slots, stamped, SLOT_KEY, ("activated_at", "created_at"), order)


def transition(routes: DataFrame, changes: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Apply status changes (route key, ``to``, ``message``, ``actor``) by key.

    ``to`` is RELEASED, FAILED or RECOVERED. Of several changes of a route the last one counts.
    """
    c = last_per_key(changes, ROUTE_KEY, order).select(*ROUTE_KEY, "to", "message", "actor")
    joined = routes.join(c, list(ROUTE_KEY), "left")
    to = F.col("to")
    known = to.isin(*TRANSITIONS)

    def status(column: str) -> Column:
        out = F.col(column)
        for name, values in TRANSITIONS.items():
            out = F.when(to == name, values[column]).otherwise(out)
        return out

    changed = {
        "routing_status": status("routing_status"),
        "source_status": status("source_status"),
        "last_error_message": F.when(to.isin("RELEASED", "FAILED"), F.col("message"))
        .when(to == "RECOVERED", None)
        .otherwise(F.col("last_error_message")),
        "released_at": F.when(to == "RELEASED", now).when(to == "RECOVERED", None).otherwise(F.col("released_at")),
        "last_synced_at": F.when(known, now).otherwise(F.col("last_synced_at")),
        "updated_by": F.when(known, F.col("actor")).otherwise(F.col("updated_by")),
        "updated_at": F.when(known, now).otherwise(F.col("updated_at")),
    }
    return joined.withColumns(changed).select(*routes.columns)


def deactivate_slots(slots: DataFrame, released: DataFrame, now: Column, match_org: bool = True) -> DataFrame:
    """Close the slots of released objects.

    Matches the organisation and active slots only, and sets the note. ``match_org=False``
    closes the object's slots of every organisation and leaves the note.
    """
    keys = list(SLOT_KEY) if match_org else ["routing_protocol", "selected_object"]
    hit = last_per_key(released.select(*keys, F.col("note").alias("_note")), keys) if match_org else released.select(*keys).distinct()
    joined = slots.join(hit.withColumn("_hit", F.lit(True)), keys, "left")
    match = F.col("_hit") & F.col("is_active") if match_org else F.col("_hit")
    changed = {
        "deactivated_at": F.when(match, now).otherwise(F.col("deactivated_at")),
        "updated_at": F.when(match, now).otherwise(F.col("updated_at")),
        "note": F.when(match, F.col("_note")).otherwise(F.col("note")) if match_org else F.col("note"),
        "is_active": F.when(match, False).otherwise(F.col("is_active")),
    }
    return joined.withColumns(changed).select(*slots.columns)


def release_unsynced(routes: DataFrame, syncs: DataFrame, now: Column, message: str) -> DataFrame:
    """Release the routes a sync (``org_key``, ``my_domain``, ``synced_at``) did not see."""
    latest = syncs.groupBy("org_key", "my_domain").agg(F.max("synced_at").alias("synced_at"))
    joined = routes.join(latest, ["org_key", "my_domain"], "left")
    missed = F.col("synced_at").isNotNull() & (
        F.col("last_synced_at").isNull() | (F.col("last_synced_at") < F.col("synced_at"))
    )
    changed = {
        "routing_status": F.lit("RELEASED"),
        "source_status": F.lit("INACTIVE"),
        "last_error_message": F.lit(message),
        "released_at": now,
        "updated_by": F.lit("sync"),
        "updated_at": now,
        "last_synced_at": now,
    }
    missed_col = joined.withColumn("_missed", missed)
    return missed_col.withColumns(
        {c: F.when(F.col("_missed"), v).otherwise(F.col(c)) for c, v in changed.items() if c in routes.columns}
    ).select(*routes.columns)


def set_default(orgs: DataFrame, new_default: Column) -> DataFrame:
    """Exactly the named organisation is the default."""
    return orgs.withColumn("is_default", F.coalesce(F.col("org_key") == new_default, F.lit(False)))


def default_for_first(orgs: DataFrame, new_orgs: DataFrame) -> DataFrame:
    """Add organisations; the first one (by key) becomes default when none is."""
    # Scalar subqueries of the one plan.
    taken = orgs.agg(F.coalesce(F.max("is_default"), F.lit(False))).scalar()
    first = new_orgs.agg(F.min("org_key")).scalar()
    return orgs.unionByName(set_default(new_orgs, F.when(~taken, first)).select(*orgs.columns))


def merge_attributes(stored: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """New attributes over the stored ones; a blank new value keeps the stored one.

    Updates of one key apply by ``order``; without it, a key has one update. Of each attribute
    the last value that isn't blank counts.
    """
    given = [c for c in updates.columns if c not in (key, order)]
    place = F.col(order) if order else F.lit(0)
    last = [F.max_by(c, F.when(non_blank(F.col(c)).isNotNull(), place)).alias(c) for c in given]
    o, n = stored.alias("o"), updates.groupBy(key).agg(*last).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    names = [c for c in stored.columns if c != key]
    merged = [
        (F.coalesce(non_blank(F.col(f"n.{c}")), F.col(f"o.{c}")) if c in given else F.col(f"o.{c}")).alias(c)
        for c in names
    ]
    return joined.select(F.col(f"o.{key}").alias(key), *merged)


# -- filters and lookups ----------------------------------------------------------------


def active_routes(routes: DataFrame, org: str | Column | None = None) -> DataFrame:
    """Active routes in listing order (F1, O1)."""
    out = routes.where(F.col("routing_status") == "ACTIVE")
    if org is not None:
        return out.where(F.col("org_key") == org).orderBy("selected_object", "routing_protocol")
    return out.orderBy("org_name", "selected_object", "routing_protocol", "org_key")


def recoverable_routes(routes: DataFrame) -> DataFrame:
    """Routes a restart should bring back, failed ones included (F2, O1)."""
    blank = F.lit("")
    return routes.where(
        (F.coalesce("routing_status", blank) != "RELEASED") & (F.coalesce("source_status", blank) != "INACTIVE")
    ).orderBy("org_name", "selected_object", F.desc("routing_protocol"), "org_key")


def both_active(routes: DataFrame, org: str | Column) -> DataFrame:
    """One organisation's routes that are active on both sides."""
    on = (F.col("routing_status") == "ACTIVE") & (F.col("source_status") == "ACTIVE")
    return routes.where(on & (F.col("org_key") == org)).orderBy("selected_object", F.desc("routing_protocol"))


def skipped(routes: DataFrame) -> DataFrame:
    """Routes a restart leaves alone."""
    return routes.where(
        (F.upper("source_status") == "INACTIVE") | F.upper("routing_status").isin("RELEASED", "FAILED")
    )


def find_route(routes: DataFrame, org: str | Column, obj: str | Column, protocol: str | Column) -> DataFrame:
    """The one route of a key."""
    return routes.where(
        (F.col("org_key") == org) & (F.col("selected_object") == obj) & (F.col("routing_protocol") == protocol)
    ).limit(1)


def matched_objects(objects: DataFrame, routes: DataFrame) -> DataFrame:
    """Objects (``selected_object``, ``routing_protocol``) some active route serves."""
    r = routes.where(F.col("routing_status") == "ACTIVE")
    r = r.select(F.col("selected_object").alias("_o"), F.upper("routing_protocol").alias("_p"))
    return objects.join(
        r, (F.col("selected_object") == F.col("_o")) & (F.upper("routing_protocol") == F.col("_p")), "left_semi"
    )


def route_detail(routes: DataFrame, counts: DataFrame, fields: DataFrame) -> DataFrame:
    """Routes with the row count and field list of their target.

    ``counts``: ``target_table``, ``n``; ``fields``: ``selected_object``, ``name``. The two
    warning columns say that a count is 0 or missing and that no field was found. A field
    list is one object's describe result, which the source bounds.
    """
    listed = fields.groupBy("selected_object").agg(F.array_sort(F.collect_list("name")).alias("fields"))
    joined = routes.join(counts, "target_table", "left").join(listed, "selected_object", "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return joined.select(
        *ROUTE_KEY,
        "target_table",
        n.alias("synced_record_count"),
        F.coalesce("fields", F.array().cast("array<string>")).alias("fields"),
        (n == 0).alias("record_count_warning"),
        F.col("fields").isNull().alias("field_load_warning"),
    )


def option_lookup(requests: DataFrame, options: DataFrame, request_id: str, option_id: str) -> DataFrame:
    """Each request with its option's name, or a reject reason."""
    o = options.select(F.col(option_id).alias("_id"), F.col("name").alias("option_name"))
    joined = requests.join(o, F.col(request_id) == F.col("_id"), "left")
    return joined.withColumn("reject_reason", F.when(F.col("_id").isNull(), "no_option")).drop("_id")


# -- aggregates -------------------------------------------------------------------------


def active_slot_count(slots: DataFrame, protocol: str) -> DataFrame:
    """Active slots of a protocol (A1)."""
    hit = F.col("is_active") & (F.col("routing_protocol") == protocol)
    return slots.where(hit).agg(F.count(F.lit(1)).alias("used"))


def slot_summary(slots: DataFrame) -> DataFrame:
    """Active slots of all protocols and the limit (A2)."""
    used = F.coalesce(F.sum(F.when(F.col("is_active"), 1).otherwise(0)), F.lit(0)).cast("bigint")
    return slots.agg(used.alias("used")).withColumn("limit", F.lit(SLOT_LIMIT))


def slot_availability(slots: DataFrame, protocol: str) -> DataFrame:
    """Used and free slots of a protocol (A3)."""
    used = active_slot_count(slots, protocol)
    return used.select(
        "used",
        F.lit(SLOT_LIMIT).alias("limit"),
        F.greatest(F.lit(SLOT_LIMIT) - F.col("used"), F.lit(0)).cast("bigint").alias("available"),
    )


def orgs_grouped(routes: DataFrame) -> DataFrame:
    """One row per organisation with an active route (A4)."""
    names = ("org_name", "instance_name", "org_type", "is_sandbox", "my_domain")
    active = routes.where(F.col("routing_status") == "ACTIVE")
    return active.groupBy("org_key").agg(*[F.max(n).alias(n) for n in names]).orderBy("org_name", "org_key")


def orgs_distinct(routes: DataFrame) -> DataFrame:
    """Distinct organisation attributes of active routes (A5)."""
    names = (
        "org_key", "org_name", "my_domain", "target_storage_id", "target_storage_name",
        "target_schema", "instance_name", "org_type", "is_sandbox",
    )
    return routes.where(F.col("routing_status") == "ACTIVE").select(*names).distinct().orderBy("org_name", *[n for n in names if n != "org_name"])


def dashboard_counts(routes: DataFrame) -> DataFrame:
    """Active routes, organisations and routes per protocol.

    Grouped by organisation first, so that no distinct count shuffles every route.
    """
    protocol = F.col("routing_protocol")
    per_org = routes.where(F.col("routing_status") == "ACTIVE").groupBy("org_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(protocol == "STREAMING").alias("s"),
        F.count_if(protocol == "CDC").alias("c"),
    )
    zero = F.lit(0).cast("bigint")
    return per_org.agg(
        F.coalesce(F.sum("n"), zero).alias("active_route_count"),
        F.count(F.lit(1)).alias("active_org_count"),
        F.coalesce(F.sum("s"), zero).alias("streaming_count"),
        F.coalesce(F.sum("c"), zero).alias("cdc_count"),
    )


def first_org(orgs: DataFrame, fallback_key: str = "-") -> DataFrame:
    """The first organisation by name, or a row of defaults when there is none."""
    names = ("org_key", "org_name", "instance_name", "org_type", "is_sandbox", "my_domain")
    spark = orgs.sparkSession
    defaults = spark.range(1).select(
        F.lit(fallback_key).alias("org_key"),
        *[F.lit("-").alias(n) for n in names[1:4]],
        F.lit(False).alias("is_sandbox"),
        F.lit("-").alias("my_domain"),
    )
    ranked = orgs.select(*names, F.lit(0).alias("_rank")).unionByName(defaults.withColumn("_rank", F.lit(1)))
    return ranked.orderBy("_rank", "org_name", "org_key").limit(1).drop("_rank")


def status_by_object(routes: DataFrame) -> DataFrame:
    """Protocol per object: with both, STREAMING, which sorts last.

    Aggregates a flag, not the name: a maximum of text would need a sort before the shuffle.
    """
    protocol = F.upper("routing_protocol")
    active = routes.where((F.col("routing_status") == "ACTIVE") & protocol.isin(*PROTOCOLS))
    active = active.where(strip("selected_object") != "")
    streaming = F.max((protocol == "STREAMING").cast("int"))
    per_object = active.groupBy("selected_object").agg(streaming.alias("_s"))
    status = F.when(F.col("_s") == 1, "STREAMING").otherwise("CDC")
    return per_object.select("selected_object", status.alias("status"))


def recovery_outcomes(routes: DataFrame, running: DataFrame, credentials: DataFrame) -> DataFrame:
    """Outcome of a restart per route: skipped, recovered or failed.

    A route with a blank key part or already in ``running`` is skipped; one whose
    organisation has no credential fails.
    """
    r = recoverable_routes(routes)
    keys = list(ROUTE_KEY)
    joined = r.join(running.select(*keys).withColumn("_running", F.lit(True)), keys, "left")
    joined = joined.join(credentials.select("org_key").distinct().withColumn("_known", F.lit(True)), "org_key", "left")
    incomplete = reduce(lambda a, b: a | b, (non_blank(F.col(k)).isNull() for k in keys))
    outcome = (
        F.when(incomplete | F.col("_running").isNotNull(), "skipped")
        .when(F.col("_known").isNull(), "failed")
        .otherwise("recovered")
    )
    return joined.select(*keys, outcome.alias("outcome"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def restarts_per_org(requested: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes restarted per requested organisation; NOT_FOUND when it has none.

    The restarted routes themselves are the rows of ``routes``: an organisation may hold
    most of them, so they are not collected into its row.
    """
    per_org = routes.groupBy("org_key").agg(F.count(F.lit(1)).alias("restarted_count"))
    joined = requested.join(per_org, "org_key", "left")
    n = F.coalesce("restarted_count", F.lit(0).cast("bigint"))
    return joined.select(
        "org_key", n.alias("restarted_count"), F.when(n == 0, "NOT_FOUND").otherwise("SUCCESS").alias("status")
    )


def transition_events(routes: DataFrame, changes: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """The history event of every route that ``transition`` changes, from its row before."""
    c = last_per_key(changes, ROUTE_KEY, order).where(F.col("to").isin(*TRANSITIONS)).select(*ROUTE_KEY, "to", "message", "actor")
    after = F.col("routing_status")
    for name, values in TRANSITIONS.items():
        after = F.when(F.col("to") == name, values["routing_status"]).otherwise(after)
    return routes.select(*ROUTE_KEY, "routing_status").join(c, list(ROUTE_KEY)).select(
        *ROUTE_KEY, F.col("to").alias("event_type"), F.col("routing_status").alias("status_before"),
        after.alias("status_after"), "message", "actor", now.alias("event_at"),
    )


def append_history(rows: DataFrame, path: str) -> None:
    """Append events to a history table."""
    rows.write.mode("append").parquet(path)
