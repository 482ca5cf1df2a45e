"""Keys, table and schema names, connection strings and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.columns import strip

# Default ports, name lengths.
DEFAULT_PORTS = {"MARIADB": 3306, "MYSQL": 3306, "POSTGRESQL": 5432, "ORACLE": 1521}
TABLE_NAME_LENGTH = 30
SCHEMA_NAME_LENGTH = 48
HASH_LENGTH = 8


def _re(col: Column, pattern: str, to: str = "") -> Column:
    """Used for conditional edits too: a chain of these names its input only once, while
    nested ``when(v ..).otherwise(v)`` doubles the expression at every step."""
    return F.regexp_replace(col, pattern, to)


def non_blank(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def first_non_blank(*cols: Column, default: str = "-") -> Column:
    return F.coalesce(*[non_blank(c) for c in cols], F.lit(default))


def org_key(raw: Column) -> Column:
    """Host of an instance address, lower case; '' when blank."""
    v = strip(F.coalesce(raw, F.lit("")))
    v = _re(v, r"(?s)^<([^|]*)\|.*>$", "$1")
    # authority without user and port; anything else falls through to the cuts below
    v = _re(v, r"^https?://(?:[^/?#@]*@)?([A-Za-z0-9.-]+)(?::\d*)?(?:[/?#].*)?$", "$1")
    v = strip(_re(_re(v, "^https?://"), "/+$"))
    return F.lower(_re(v, "(?s)/.*$"))


def route_key(org: Column, obj: Column, protocol: Column) -> Column:
    """``org::PROTOCOL::object`` (C11)."""
    blank = F.lit("")
    return F.concat_ws(
        "::",
        org_key(org),
        F.upper(strip(F.coalesce(protocol, blank))),
        strip(F.coalesce(obj, blank)),
    )


def mask(text: Column) -> Column:
    """Hide all but the ends of a value."""
    n = F.length(text)
    return (
        F.when(text.isNull() | (strip(text) == ""), None)
        .when(n <= 2, F.repeat(F.lit("*"), n))
        .when(n <= 4, F.concat(F.substring(text, 1, 1), F.lit("***")))
        .otherwise(F.concat(F.substring(text, 1, 2), F.lit("******"), F.right(text, F.lit(2))))
    )


def mask_properties(properties: Column) -> Column:
    """Hide the values of secret-looking keys of a map."""
    return F.transform_values(
        properties,
        lambda k, v: F.when(v.isNull(), "null")
        .when(F.lower(k).rlike("password|secret|token"), "****")
        .otherwise(v),
    )


def _trim_underscores(col: Column) -> Column:
    return _re(col, "^_+|_+$")


def _name_part(col: Column, fallback: str) -> Column:
    v = _trim_underscores(_re(F.upper(strip(F.coalesce(col, F.lit("")))), "[^A-Z0-9]+", "_"))
    return _re(_re(v, "^$", fallback), "^(?=[0-9])", "ORG_")


def prefixed_table_name(org: Column, obj: Column) -> Column:
    """``ORG_<org>_<object>``, shortened with a hash beyond 30 characters (C14)."""
    given = F.upper(strip(F.coalesce(obj, F.lit(""))))

    def bare(part: Column) -> Column:
        return _re(_re(part, "^(ORG_)+"), "^$", "ORG")

    full = F.concat_ws("_", F.lit("ORG"), bare(_name_part(org, "ORG")), bare(_name_part(obj, "OBJECT")))
    head = _trim_underscores(F.substring(full, 1, TABLE_NAME_LENGTH - HASH_LENGTH - 1))
    digest = F.upper(F.substring(F.sha1(full), 1, HASH_LENGTH))
    return (
        F.when(given.rlike("^ORG_[A-Z0-9_]+_[A-Z0-9_]+$"), given)
        .when(F.length(full) <= TABLE_NAME_LENGTH, full)
        .otherwise(F.concat_ws("_", head, digest))
    )


def org_schema_name(org_name: Column) -> Column:
    """``org_`` and the organisation's name, made safe as a schema name."""
    raw = _re(F.coalesce(org_name, F.lit("")), r"^\s*$", "default_org")
    plain = _re(strip(raw), r"\s+", " ")
    ok = plain.rlike(r"^[A-Za-z][A-Za-z0-9_ ]{1,47}$")

    v = _re(_re(strip(raw), r"\p{Cntrl}", " "), "[^A-Za-z0-9_ ]", "_")
    v = _re(_re(_re(v, r"\s+", "_"), "_+", "_"), "^_+|_+$")
    v = _re(_re(_re(v, "^(?=[0-9])", "org_"), "^(.)$", "$1_org"), "^$", "org_default")
    coerced = F.substring(v, 1, SCHEMA_NAME_LENGTH)

    name = F.translate(F.lower(F.when(ok, plain).otherwise(coerced)), " ", "_")
    name = _re(_re(_re(name, "_+", "_"), "^_+|_+$"), "^$", "default_org")
    return F.concat(F.lit("org_"), F.substring(name, 1, SCHEMA_NAME_LENGTH))


def storage_schema_name(vendor: Column, schema_name: Column, username: Column) -> Column:
    """Schema a storage writes to: the user for Oracle, else a safe ``org_`` name."""
    v = _re(_re(F.lower(strip(schema_name)), r"[\s-]+", "_"), "[^a-z0-9_]")
    v = _re(_re(_re(v, "^(?!org_)", "org_"), "_+", "_"), "_$")
    named = F.when(strip(schema_name) == "", schema_name).otherwise(v)
    by_user = F.upper(strip(F.coalesce(non_blank(username), non_blank(schema_name))))
    return F.when(vendor == "ORACLE", by_user).otherwise(named)


def connection(vendor: Column, raw_url: Column) -> Column:
    """Parts of a connection string: host, port, database, service, sid (C17).

    A string without a readable host gives a struct of nulls.
    """
    v = _re(strip(raw_url), r"\s")
    v = _re(v, "^jdbc:")
    # a link wrapper "<target|label>", around the whole string or inside it
    v = _re(_re(v, r"\|.*$"), "[<>]")
    # everything up to the scheme separator, then fragment, query, trailing slashes
    v = _re(_re(v, r"^.*?://"), "^//")
    v = _re(_re(_re(v, "#.*$"), r"\?.*$"), "/+$")

    oracle = vendor == "ORACLE"
    tcp = _re(_re(v, "^(mariadb|mysql|postgresql):(//)?"), "^.*?://")
    thin = _re(_re(v, "^oracle:thin:@(//)?"), "^.*?://")
    address = F.when(oracle, F.substring_index(thin, "/", 1)).otherwise(F.substring_index(tcp, "/", 1))
    path = F.when(oracle, F.regexp_extract(thin, "^[^/]*/([^/]+)", 1)).otherwise(
        F.regexp_extract(tcp, "^[^/]*/([^/]+)", 1)
    )
    # Without a path, the last ":" of an Oracle address separates the sid.
    has_sid = oracle & ~thin.contains("/") & thin.contains(":")
    sid = F.when(has_sid, F.regexp_extract(thin, "^.+:([^:]+)$", 1))
    address = F.when(has_sid, F.regexp_extract(thin, "^(.+):[^:]*$", 1)).otherwise(address)

    host = non_blank(F.regexp_extract(address, r"^(?:[^@]*@)?([A-Za-z0-9]([A-Za-z0-9.-]*[A-Za-z0-9])?)(:\d*)?$", 1))
    port = F.regexp_extract(address, r":(\d+)$", 1).try_cast("int")
    fallback = F.lit(None).cast("int")
    for name, number in DEFAULT_PORTS.items():
        fallback = F.when(vendor == name, number).otherwise(fallback)
    known = vendor.isin(*DEFAULT_PORTS) & host.isNotNull() & (~has_sid | (strip(sid) != ""))
    path = non_blank(path)

    def part(value: Column, name: str) -> Column:
        return F.when(known, value).alias(name)

    return F.struct(
        part(host, "host"),
        part(F.coalesce(F.when(port > 0, port), fallback), "port"),
        part(F.when(~oracle, path), "database"),
        part(F.when(oracle, path), "service"),
        part(non_blank(sid), "sid"),
    )


def connection_url(
    vendor: Column, host: Column, port: Column, database: Column, service: Column, sid: Column
) -> Column:
    """Canonical connection string of the parts; null without a host."""
    at = F.concat_ws(":", host, port.cast("string"))
    tcp = F.concat(F.lit("jdbc:"), F.lower(vendor), F.lit("://"), at)
    tcp = F.when(non_blank(database).isNotNull(), F.concat(tcp, F.lit("/"), database)).otherwise(tcp)
    thin = (
        F.when(non_blank(service).isNotNull(), F.concat(F.lit("jdbc:oracle:thin:@//"), at, F.lit("/"), service))
        .when(non_blank(sid).isNotNull(), F.concat(F.lit("jdbc:oracle:thin:@"), at, F.lit(":"), sid))
        .otherwise(F.concat(F.lit("jdbc:oracle:thin:@//"), at))
    )
    return F.when(host.isNotNull(), F.when(vendor == "ORACLE", thin).otherwise(tcp))
