"""Searching, sorting and paging an object catalogue."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.naming import org_key

# Page sizes.
LIST_SIZES = (10, 20, 50, 100)
LIST_DEFAULT = 20
SEARCH_MAX = 200
PAGE_WINDOW = 2


def search(objects: DataFrame, query: str | None) -> DataFrame:
    """Objects whose label or name contains the text, whatever its case."""
    q = (query or "").strip().lower()
    if not q:
        return objects

    def has(c: str) -> Column:
        return F.lower(F.coalesce(c, F.lit(""))).contains(q)

    return objects.where(has("label") | has("name"))


def with_status(objects: DataFrame, statuses: DataFrame) -> DataFrame:
    """Objects with the protocol that serves them, NONE when none does."""
    s = statuses.select(F.col("selected_object").alias("name"), F.col("status"))
    return objects.join(s, "name", "left").withColumn("status", F.coalesce("status", F.lit("NONE")))


def filter_status(objects: DataFrame, wanted: str | None) -> DataFrame:
    """Keep one status; anything but NONE, STREAMING or CDC keeps all."""
    w = (wanted or "").strip().upper()
    return objects.where(F.col("status") == w) if w in ("NONE", "STREAMING", "CDC") else objects


def _low(c: str) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def list_order(sort: str | None) -> list[Column]:
    """Sort keys of the catalogue listing, with the name as a final unique key (O2)."""
    label, api, status = _low("label"), _low("name"), F.lower("status")
    orders = {
        "LABEL_ASC": [label.asc(), api.asc()],
        "LABEL_DESC": [label.desc(), api.asc()],
        "API_ASC": [api.asc(), label.asc()],
        "API_DESC": [api.desc(), label.asc()],
        "STATUS_ASC": [status.asc(), label.asc()],
        "STATUS_DESC": [status.desc(), label.desc()],
    }
    return [*orders.get((sort or "").strip().upper(), orders["LABEL_ASC"]), F.col("name").asc()]


def service_order(sort: str | None) -> list[Column]:
    """Sort keys of the search service: by name unless a label order is named (O3)."""
    label, api = _low("label"), _low("name")
    orders = {
        "LABEL_ASC": [label.asc(), api.asc()],
        "LABEL_DESC": [label.desc(), api.desc()],
        "API_DESC": [api.desc()],
    }
    return [*orders.get((sort or "").strip().upper(), [api.asc()]), F.col("name").asc()]


def search_page(
    objects: DataFrame, query: str | None, sort: str | None, page: int, size: int
) -> tuple[DataFrame, DataFrame]:
    """(rows of one page, total) of a search."""
    page, size = max(page, 1), max(1, min(size, SEARCH_MAX))
    found = search(objects, query)
    rows = found.orderBy(*service_order(sort)).offset((page - 1) * size).limit(size)
    return rows, found.agg(F.count(F.lit(1)).alias("total"))


def list_size(size: int | None) -> int:
    return size if size in LIST_SIZES else LIST_DEFAULT


def page_info(objects: DataFrame, size: int | None, page: int) -> DataFrame:
    """Page figures of a listing, one row."""
    n = list_size(size)
    total = objects.agg(F.count(F.lit(1)).alias("total"))
    one = F.lit(1).cast("bigint")
    pages = F.ceil(F.greatest("total", one) / F.lit(n)).cast("bigint")
    df = total.withColumn("pages", pages)
    df = df.withColumn("page", F.least(F.greatest(F.lit(page).cast("bigint"), one), F.col("pages")))
    start = F.least((F.col("page") - 1) * n, F.col("total"))
    df = df.withColumn("from_index", start)
    df = df.withColumns(
        {
            "start_index": F.when(F.col("total") == 0, 0).otherwise(F.col("from_index") + 1).cast("bigint"),
            "end_index": F.least(F.col("from_index") + n, F.col("total")),
        }
    )
    w = F.lit(PAGE_WINDOW)
    low, high = F.greatest(one, F.col("page") - w), F.least(F.col("pages"), F.col("page") + w)
    # A window cut off at one end is extended at the other.
    first = F.when((high - low < 2 * w) & (low != 1) & (high == F.col("pages")), F.greatest(one, high - 2 * w))
    last = F.when((high - low < 2 * w) & (low == 1), F.least(F.col("pages"), low + 2 * w))
    numbers = F.sequence(F.coalesce(first, low), F.coalesce(last, high))
    return df.withColumn("page_numbers", numbers).drop("from_index")


def filtered_page(objects: DataFrame, wanted: str | None, sort: str | None, page: int, size: int) -> DataFrame:
    """One page of the objects with a status."""
    page = max(1, page)
    kept = filter_status(objects, wanted)
    return kept.orderBy(*list_order(sort)).offset((page - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return math.ceil(total / size) if size > 0 else 0


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by ``durable_id``: the first source wins.

    Inside the first source the later ``position`` of an id wins, inside the second the
    earlier. One aggregation, combined before its shuffle.
    """
    rank = F.struct(F.lit(1).alias("r"), F.col("position").alias("p"))
    low = F.struct(F.lit(0).alias("r"), (-F.col("position")).alias("p"))
    both = first.withColumn("_rank", rank).unionByName(second.withColumn("_rank", low))
    return both.groupBy("durable_id").agg(
        F.max_by("name", "_rank").alias("name"), F.max_by("label", "_rank").alias("label")
    )


def is_sandbox(address: Column) -> Column:
    """Whether an instance address names a test system."""
    return org_key(address).rlike("sandbox|test")


def valid_identifier(name: Column) -> Column:
    """Names that may be schema, table or column names."""
    return F.coalesce(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def valid_record_key(key: Column) -> Column:
    """18 letters or digits."""
    return F.coalesce(key.rlike("^[A-Za-z0-9]{18}$"), F.lit(False))


def valid_simple_key(key: Column) -> Column:
    """Short keys of letters, digits and ``. _ : -``."""
    return F.coalesce(key.rlike("^[A-Za-z0-9._:-]{1,120}$"), F.lit(False))


def fiscal_fields(entries: Column) -> Column:
    """The entries of a map whose names speak of fiscal periods."""
    return F.map_filter(entries, lambda k, _: F.lower(k).rlike("fiscal|quarter|year"))


def value_lengths(entries: Column) -> Column:
    """(field, length) of a mutation's values, longest first."""
    pairs = F.transform(
        F.map_entries(entries),
        lambda e: F.struct((-F.coalesce(F.length(e["value"]), F.lit(0))).alias("n"), e["key"].alias("field")),
    )
    return F.transform(F.array_sort(pairs), lambda p: F.struct(p["field"].alias("field"), (-p["n"]).alias("length")))

