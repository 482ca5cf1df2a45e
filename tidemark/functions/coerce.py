"""Text values to typed columns, by source type.

Each function returns the typed value, or null for text it cannot read; ``invalid`` tells
those apart from blank or missing values, so that a job can send the row to its rejects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.columns import strip

# Source types and the Spark types that hold them.
SPARK_TYPES: dict[str, T.DataType] = {
    "id": T.StringType(),
    "reference": T.StringType(),
    "textarea": T.StringType(),
    "string": T.StringType(),
    "picklist": T.StringType(),
    "multipicklist": T.StringType(),
    "phone": T.StringType(),
    "url": T.StringType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "double": T.DoubleType(),
    "percent": T.DoubleType(),
    "currency": T.DoubleType(),
    "int": T.IntegerType(),
}

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DIGITS = r"^-?\d+$"
_ZONE = r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})"
_CLOCK = r"\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
_DATETIME = rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}{_ZONE}?$"


def spark_type(source_type: str) -> T.DataType:
    return SPARK_TYPES.get(source_type, T.StringType())


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def to_double(text: Column) -> Column:
    t = strip(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def to_int(text: Column) -> Column:
    """Whole numbers; a number with a fraction is cut off toward zero."""
    t = strip(text)
    return (
        F.when(t.rlike(_DIGITS) | t.rlike(r"^\+\d+$"), t.try_cast("int"))
        .when(t.rlike(_NUMBER), t.try_cast("double").try_cast("int"))
    )


def to_boolean(text: Column) -> Column:
    t = F.lower(strip(text))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


# Fixed value: the last millisecond of the year 9999.
_LAST_MILLIS = 253_402_300_799_999


def from_epoch(number: Column) -> Column:
    """Up to ten digits are seconds, more are milliseconds; null beyond the year 9999."""
    return F.when(
        number.between(-9_999_999_999, 9_999_999_999), F.timestamp_seconds(number)
    ).when(number.between(-_LAST_MILLIS, _LAST_MILLIS), F.timestamp_millis(number))


def _temporal(text: Column) -> Column:
    return F.replace(F.replace(strip(text), F.lit(".000+0000"), F.lit("")), F.lit(" "), F.lit("T"))


def to_datetime(text: Column) -> Column:
    t = _temporal(text)
    # Spark reads no time without seconds. A local time is UTC: name the zone, so that the
    # session's does not matter.
    whole = F.regexp_replace(t, r"(T\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    zoned = F.regexp_replace(whole, rf"(T{_CLOCK})$", "$1Z")
    return (
        F.when(t.rlike(_DIGITS), from_epoch(t.try_cast("bigint")))
        .when(t.rlike(_DATETIME), zoned.try_cast("timestamp"))
    )


def to_date(text: Column) -> Column:
    t = _temporal(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date")).otherwise(
        to_datetime(text).cast("date")
    )


def clock_text(ts: Column) -> Column:
    """``HH:mm:ss``, with six fraction digits only when there is a fraction."""
    whole = F.date_format(ts, "HH:mm:ss")
    return F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, whole).otherwise(
        F.date_format(ts, "HH:mm:ss.SSSSSS")
    )


def datetime_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with the same fraction rule."""
    return F.when(ts.isNotNull(), F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd"), clock_text(ts)))


def to_time(text: Column) -> Column:
    """Time of day as text, shifted to UTC when the text names an offset."""
    t = _temporal(text)
    bare = t.rlike(rf"^{_CLOCK}{_ZONE}?$")
    moment = F.when(bare, to_datetime(F.concat(F.lit("1970-01-01T"), t))).otherwise(to_datetime(text))
    return clock_text(moment)


_READERS: dict[str, Callable[[Column], Column]] = {
    "boolean": to_boolean,
    "datetime": to_datetime,
    "date": to_date,
    "time": to_time,
    "double": to_double,
    "percent": to_double,
    "currency": to_double,
    "int": to_int,
}

#: Types whose blank text is null; elsewhere blank text is not a value.
_BLANK_IS_NULL = ("datetime", "date", "time")


def coerce(text: Column, source_type: str) -> Column:
    reader = _READERS.get(source_type)
    return text if reader is None else reader(text)


def unread(text: Column, value: Column, source_type: str) -> Column:
    """True where ``text`` is a value, but coercing it to this type gave none."""
    if source_type not in _READERS:
        return F.lit(False)
    bad = text.isNotNull() & value.isNull()
    return bad & ~blank(text) if source_type in _BLANK_IS_NULL else bad


def invalid(text: Column, source_type: str) -> Column:
    """True for text that is a value but not one of this type."""
    return unread(text, coerce(text, source_type), source_type)


def json_scalar(text: Column) -> Column:
    """A JSON scalar as (kind, bool, long, decimal, text)."""
    t = strip(text)
    quoted = t.rlike('^".*"$')
    kind = (
        F.when(t.isNull() | (t == "null"), "null")
        .when(t.isin("true", "false"), "bool")
        .when(t.rlike(r"^-?\d+$"), "long")
        .when(t.rlike(_NUMBER), "decimal")
        .otherwise("text")
    )
    unquoted = F.when(quoted, F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v"))
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "bool", t == "true").alias("bool"),
        F.when(kind == "long", t.try_cast("bigint")).alias("long"),
        F.when(kind == "decimal", t.try_cast("double")).alias("decimal"),
        F.when(kind == "text", F.coalesce(unquoted, t)).alias("text"),
    )
