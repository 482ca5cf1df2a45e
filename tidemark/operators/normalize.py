"""Change events to mutations (P1-P20): which fields an event touches, and their values.

Both feeds arrive as JSON text. It is read as ``map<string,string>``, which keeps an
absent field apart from a null one and leaves nested objects as JSON text. Everything is a
column expression over the events: no shuffle, no Python.

A normalised row has ``seq``, the key, ``change_type``, ``lm``, ``ev``, ``target_fields``,
``nulled_fields``, ``vals`` (one text field per described field) and ``reject_reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.columns import CHANGE_TYPES, KEY, WHITE_SPACE, pinned, strip
from tidemark.functions.coerce import blank, coerce, to_datetime, unread

# Names in the two feeds' payloads.
HEADER = "ChangeEventHeader"
ENVELOPE_KEYS = (HEADER, "Id", "schema")
ADDRESS_PARENTS = ("Other", "Mailing", "Billing", "Shipping")
ADDRESS_PARTS = (
    "Street", "City", "State", "PostalCode", "Country", "Latitude", "Longitude", "GeocodeAccuracy",
)
ADDRESS_TEXT_ORDER = ("Country", "State", "City", "Street", "PostalCode")
NAME_TEXT_ORDER = ("Salutation", "LastName", "FirstName")
NAME_DISPLAY = ("displayValue", "value", "stringValue")
SCALAR_ALIASES = (
    "stringValue", "booleanValue", "intValue", "doubleValue",
    "longValue", "dateValue", "dateTimeValue", "timeValue",
)
FISCAL = ("Fiscal", "FiscalYear", "FiscalQuarter")
NOTICE_TYPES = {"created": "CREATE", "updated": "UPDATE", "deleted": "DELETE"}
HEADER_SCHEMA = (
    "recordIds array<string>, changeType string, commitTimestamp string, "
    "changedFields array<string>, nulledFields array<string>"
)

_MAP = "map<string,string>"


def _members(text: Column) -> Column:
    """The members of a JSON object; of a repeated name the last one counts."""

    def once(entries: Column) -> Column:
        names = F.map_keys(entries)
        later = lambda e, i: F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])
        last = F.map_from_entries(F.filter(F.map_entries(entries), lambda e, i: ~later(e, i)))
        return F.when(F.size(F.array_distinct(names)) < F.size(names), last).otherwise(entries)

    return F.transform(F.array(F.from_json(text, _MAP)), once)[0]


def _lead(text) -> Column:
    """The text without white space at its start: tells how it begins without a look at its end."""
    return F.ltrim(text, F.lit(WHITE_SPACE))


def _object(text: Column) -> Column:
    """The entries of a JSON object, or null for any other value."""
    return F.when(_lead(text).startswith("{"), _members(text))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _either_case(entries: Column, name: str) -> Column:
    return F.coalesce(entries[name], entries[name[0].lower() + name[1:]])


def joined(entries: Column, order: tuple[str, ...]) -> Column:
    """The trimmed non-blank parts of a compound value, in order, by one space."""
    parts = [strip(_either_case(entries, n)) for n in order]
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def name_text(entries: Column) -> Column:
    """A compound name as text, or null when no part has any."""
    display = F.coalesce(*[entries[n] for n in NAME_DISPLAY])
    parts = joined(entries, NAME_TEXT_ORDER)
    return F.when(~blank(display), display).when(parts != "", parts)


def _keys(text: Column) -> Column:
    return F.when(_lead(text).startswith("{"), F.json_object_keys(text))


def unwrap(text: Column, keys: Column | None = None) -> Column:
    """The value inside a wrapper object; other text, and other objects, as they are.

    ``keys`` are the object's member names, where the caller has them.
    """
    keys = _keys(text) if keys is None else keys
    single = (F.size(keys) == 1) & keys[0].isin(*SCALAR_ALIASES)
    return (
        F.when(keys.isNull(), text)
        .when(F.array_contains(keys, "newValue"), F.get_json_object(text, "$.newValue"))
        .when(F.array_contains(keys, "value"), F.get_json_object(text, "$.value"))
        .when(single, F.map_values(F.from_json(text, _MAP))[0])
        .otherwise(text)
    )


def field_tokens(names: Column) -> Column:
    """Field names of a header list: the part after the last dot, data fields only."""
    tokens = F.transform(
        F.coalesce(names, _strings([])), lambda n: F.substring_index(strip(n), ".", -1)
    )
    return F.array_distinct(
        F.filter(tokens, lambda t: t.isNotNull() & (t != "") & ~t.isin(*ENVELOPE_KEYS))
    )


def _compound_columns(df: DataFrame, fields) -> DataFrame:
    """Entries of the compound values some described field needs: ``_name``, ``_addr_X``."""
    out = {}
    if {"Name", "FirstName", "LastName"} & set(fields):
        out["_name"] = _object(F.col("_payload")["Name"])
    for parent in ADDRESS_PARENTS:
        if f"{parent}Address" in fields or any(parent + p in fields for p in ADDRESS_PARTS):
            out[f"_addr_{parent}"] = _object(F.col("_payload")[f"{parent}Address"])
    return df.withColumns(out) if out else df


def _address_child(field: str) -> tuple[str, str] | None:
    for parent in ADDRESS_PARENTS:
        if field.startswith(parent) and field[len(parent):] in ADDRESS_PARTS:
            return parent, field[len(parent):]
    return None


def _compound_targets(fields) -> Column:
    """Fields that a compound value adds to the changed ones."""
    changed = F.array_union("_changed", "_nulled")

    def has(entries: Column, part: str) -> Column:
        return entries.isNotNull() & (entries[part].isNotNull() | F.array_contains(changed, part))

    added: list[Column] = []
    name = F.col("_name")
    if "Name" in fields:
        parts = [n for p in NAME_TEXT_ORDER for n in (p, p[0].lower() + p[1:])]
        some = has(name, parts[0])
        for p in parts[1:]:
            some = some | has(name, p)
        added.append(F.when(some, "Name"))
    added += [F.when(has(name, n), n) for n in ("FirstName", "LastName") if n in fields]
    for parent in ADDRESS_PARENTS:
        children = [p for p in ADDRESS_PARTS if parent + p in fields]
        any_child = F.lit(False)
        for p in children:
            present = has(F.col(f"_addr_{parent}"), p)
            added.append(F.when(present, parent + p))
            any_child = any_child | present
        if children and f"{parent}Address" in fields:
            added.append(F.when(any_child, f"{parent}Address"))
    return F.array_compact(F.array(*added)) if added else _strings([])


def _with_fiscal(df: DataFrame, fields) -> DataFrame:
    """Split a fiscal period object into its text, year and quarter fields."""
    df = df.withColumn("_fiscal", _object(F.col("_payload")["Fiscal"]))
    year, quarter = (strip(F.col("_fiscal")[n]) for n in ("Year", "Quarter"))
    known = [f for f in FISCAL if f in fields]
    whole = F.col("_fiscal").isNotNull() & ~blank(year) & ~blank(quarter)
    broken = F.col("_fiscal").isNotNull() & (blank(year) | blank(quarter))
    value = {"Fiscal": F.concat_ws(" ", year, quarter), "FiscalYear": year, "FiscalQuarter": quarter}
    kept = F.map_filter("_payload", lambda k, _: ~k.isin(*known)) if known else F.col("_payload")
    payload = F.when(
        whole, F.map_concat(kept, F.create_map(*[x for f in known for x in (F.lit(f), value[f])]))
    ) if known else F.when(whole, F.col("_payload"))
    return df.withColumns(
        {
            "_payload": payload.when(broken, F.map_filter("_payload", lambda k, _: k != "Fiscal"))
            .otherwise(F.col("_payload")),
            "target_fields": F.when(whole, F.array_union("target_fields", _strings(known)))
            .when(broken, F.array_except("target_fields", _strings(FISCAL)))
            .otherwise(F.col("target_fields")),
            "nulled_fields": F.when(whole, F.array_except("nulled_fields", _strings(known)))
            .when(broken, F.array_except("nulled_fields", _strings(FISCAL)))
            .otherwise(F.col("nulled_fields")),
        }
    )


def _values(fields) -> Column:
    """Text value of every described field that is targeted."""

    def value(field: str) -> Column:
        direct = F.col("_payload")[field]
        plain = F.col("_flat")[field]
        child = _address_child(field)
        if child:
            part = unwrap(F.col(f"_addr_{child[0]}")[child[1]])
            return F.when(direct.isNotNull(), plain).otherwise(part)
        if field in ("FirstName", "LastName"):
            part = unwrap(_either_case(F.col("_name"), field))
            return F.when(direct.isNotNull(), plain).otherwise(part)
        if field == "Name":
            return F.coalesce(name_text(F.col("_name")), plain)
        if field.endswith("Address") and field.removesuffix("Address") in ADDRESS_PARENTS:
            text = joined(F.col(f"_addr_{field.removesuffix('Address')}"), ADDRESS_TEXT_ORDER)
            return F.when(text != "", text).otherwise(plain)
        return plain

    def written(field: str) -> Column:
        targeted = F.array_contains("target_fields", field)
        return F.when(targeted & ~F.array_contains("nulled_fields", field), value(field)).alias(field)

    return F.struct(*[written(f) for f in fields])


def _times(df: DataFrame, now: Column, commit: Column) -> DataFrame:
    """``lm`` from the payload; ``ev`` from the commit time, else ``lm``, or now for deletes."""
    modified = F.col("_payload")["LastModifiedDate"]
    df = df.withColumns({"lm": to_datetime(modified), "_commit": to_datetime(commit)})
    late = F.when(F.col("change_type") == "DELETE", now).otherwise(F.col("lm"))
    bad = unread(modified, F.col("lm"), "datetime") | unread(commit, F.col("_commit"), "datetime")
    return df.withColumns(
        {
            "ev": F.when(~blank(commit), F.col("_commit")).otherwise(late),
            "reject_reason": F.coalesce("reject_reason", F.when(bad, "bad_time")),
        }
    )


def _finish(df: DataFrame, keep, key: str, fields) -> DataFrame:
    # Lambdas evaluate a repeated expression each time: find the member names in a step of
    # their own, and only in rows that hold some object.
    df = df.withColumn("_flat", F.map_filter("_payload", lambda k, _: k.isin(*fields)))
    df = df.withColumn("_nested", F.exists(F.map_values("_flat"), lambda v: _lead(v).startswith("{")))
    df = df.withColumn("_members", F.when(F.col("_nested"), F.transform_values("_flat", lambda _, v: _keys(v))))
    inner = F.transform_values("_flat", lambda k, v: unwrap(v, F.col("_members")[k]))
    flat = F.when(F.col("_nested"), inner).otherwise(F.col("_flat"))
    return pinned(
        df.withColumn("_flat", flat).select(
            *keep, "seq", key, "change_type", "lm", "ev", "target_fields", "nulled_fields",
            _values(fields).alias("vals"), "reject_reason",
        )
    )


def _kept_columns(events: DataFrame, used) -> list[str]:
    return [c for c in events.columns if c not in used]


def normalize_changes(
    events: DataFrame,
    field_types: dict[str, str],
    now: Column | None = None,
    key: str = KEY,
    all_record_ids: bool = False,
) -> DataFrame:
    """Nested change records (``seq``, ``body``) to mutations.

    Other columns of ``events`` are kept. With ``all_record_ids`` an event applies to every
    record it names; by default, to the first.
    """
    fields = [f for f in field_types if f not in ("Id", key)]
    keep = _kept_columns(events, ("seq", "body"))
    df = events.withColumn("_env", _members(F.col("body")))
    inner = F.map_contains_key("_env", F.lit("payload"))
    df = df.withColumn(
        "_payload", F.when(inner, _members(F.col("_env")["payload"])).otherwise(F.col("_env"))
    ).withColumn("_payload", F.map_filter("_payload", lambda k, _: (_lead(k) != "") & (k != "schema")))
    df = df.withColumn("_header", F.from_json(F.col("_payload")[HEADER], HEADER_SCHEMA))
    record_ids = F.col("_header.recordIds")
    own_id = F.col("_payload")["Id"]
    if all_record_ids:
        ids = F.when(F.size(record_ids) > 0, record_ids).otherwise(F.array(own_id))
        df = df.withColumn(key, F.explode(ids))
    else:
        df = df.withColumn(key, F.when(F.size(record_ids) > 0, record_ids[0]).otherwise(own_id))
    raw_type = F.upper("_header.changeType")
    df = df.withColumns(
        {
            "change_type": F.when(raw_type.isin(*CHANGE_TYPES), raw_type),
            "_changed": field_tokens(F.col("_header.changedFields")),
            "_nulled": field_tokens(F.col("_header.nulledFields")),
        }
    )
    df = df.withColumn(
        "reject_reason",
        F.when(F.col("_payload").isNull(), "no_payload")
        .when(F.col("_payload")[HEADER].isNull(), "no_header")
        .when(F.col("change_type").isNull(), "change_type")
        .when(blank(F.col(key)), "no_key"),
    )
    df = _compound_columns(df, fields)
    candidates = F.array_union(F.array_union("_changed", "_nulled"), _compound_targets(fields))
    df = df.withColumn("target_fields", F.array_intersect(candidates, _strings(fields)))
    # A header of bitmaps, or of nothing the table has, stands for all payload fields.
    present = F.array_intersect(F.map_keys("_payload"), _strings(fields))
    df = df.withColumns(
        {
            "target_fields": F.when(F.size("target_fields") > 0, F.col("target_fields")).otherwise(present),
            "nulled_fields": F.col("_nulled"),
        }
    )
    df = _with_fiscal(df, fields)
    df = _times(df, F.current_timestamp() if now is None else now, F.col("_header.commitTimestamp"))
    return _finish(df, keep, key, fields)


def normalize_notices(
    events: DataFrame,
    field_types: dict[str, str],
    now: Column | None = None,
    key: str = KEY,
    undelete: bool = False,
) -> DataFrame:
    """Flat notifications (``seq``, ``event_type``, ``body``) to mutations.

    Undelete notices are dropped unless ``undelete`` is set.
    """
    fields = [f for f in field_types if f not in ("Id", key)]
    keep = _kept_columns(events, ("seq", "event_type", "body"))
    notice = F.lower("event_type")
    change = F.lit(None).cast("string")
    types = {**NOTICE_TYPES, "undeleted": "UNDELETE"} if undelete else NOTICE_TYPES
    for name, kind in types.items():
        change = F.when(notice == name, kind).otherwise(change)
    df = events.withColumns({"change_type": change, "_root": _members(F.col("body"))})
    delete = F.col("change_type") == "DELETE"
    empty = F.map_from_arrays(_strings([]), _strings([]))
    df = df.withColumns(
        {
            # A delete notice names only its record: the first field, whatever it is called.
            key: F.when(delete, F.get(F.map_values("_root"), F.lit(0))).otherwise(F.col("_root")["Id"]),
            "_payload": F.when(delete, empty).otherwise(F.col("_root")),
        }
    )
    df = df.withColumns(
        {
            "reject_reason": F.when(F.col("change_type").isNull(), "change_type")
            .when(F.col("_root").isNull(), "no_payload")
            .when(blank(F.col(key)), "no_key"),
            "target_fields": F.array_intersect(F.map_keys("_payload"), _strings(fields)),
            "nulled_fields": _strings([]),
        }
    )
    df = _compound_columns(df, fields)
    df = _with_fiscal(df, fields)
    df = _times(df, F.current_timestamp() if now is None else now, F.lit(None).cast("string"))
    return _finish(df, keep, key, fields)


def typed(normalized: DataFrame, field_types: dict[str, str]) -> DataFrame:
    """Values of the described types; a value that does not fit rejects its mutation."""
    fields = normalized.schema["vals"].dataType.names
    raw, read = F.col("vals"), F.col("_typed")
    df = normalized.withColumn("_typed", F.struct(*[coerce(raw[f], field_types[f]).alias(f) for f in fields]))
    bad = F.concat_ws(",", *[F.when(unread(raw[f], read[f], field_types[f]), f) for f in fields])
    reason = F.when(bad != "", F.concat(F.lit("bad_value:"), bad))
    df = df.withColumns({"reject_reason": F.coalesce("reject_reason", reason), "vals": read})
    return pinned(df.drop("_typed"))


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reject_reason").isNotNull())


def normalize_snapshot(records: DataFrame, field_types: dict[str, str], key: str = KEY) -> DataFrame:
    """Full records (``body``) to text values of every described field.

    A record's last-modified time serves as its event time too.
    """
    fields = [f for f in field_types if f not in ("Id", key)]
    keep = _kept_columns(records, ("seq", "body"))
    df = records.withColumns({"_payload": _members(F.col("body")), "seq": F.lit(0).cast("bigint")})
    df = df.withColumns(
        {
            key: F.col("_payload")["Id"],
            "change_type": F.lit("CREATE"),
            "target_fields": _strings(fields),
            "nulled_fields": _strings([]),
            "reject_reason": F.when(F.col("_payload").isNull(), "no_payload").when(
                blank(F.col("_payload")["Id"]), "no_key"
            ),
        }
    )
    df = _compound_columns(df, fields)
    no_commit = F.lit(None).cast("string")
    return _finish(_times(df, F.lit(None).cast("timestamp"), no_commit), keep, key, fields)
