"""The guarded fold where nothing is deleted and every time is known.

Without deletes and missing times, an event is accepted if it is not older than any earlier
one of its key: a running maximum decides, and the last accepted event that sets a column gives
its value. So a batch of such events needs windows that stream through a key's rows and hash
aggregates that are combined before a shuffle, and no array of a key's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.columns import KEY, LAST_EVENT, LAST_MODIFIED
from tidemark.operators.skew import running


def accept_flags(mutations: DataFrame, key: str = KEY, **limits: int) -> DataFrame:
    """Whether each mutation of keys that are present is accepted: not older than any before it.

    ``limits`` of ``running``: keys of any size are split over tasks.
    """
    us = mutations.withColumn("lm_us", F.unix_micros("lm"))
    out = running(us, [key], ["seq"], {"newest": ("max", F.col("lm_us"))}, inclusive=False, **limits)
    return out.withColumn("accepted", F.col("newest").isNull() | (F.col("lm_us") >= F.col("newest")))


def last_accepted(mutations: DataFrame, key: str = KEY, **limits: int) -> DataFrame:
    """Per key the last accepted value of every column, and the newest time."""
    kept = accept_flags(mutations, key, **limits).where("accepted")
    names = kept.schema["vals"].dataType.names
    last = [F.max_by(F.col("vals")[n], F.when(F.array_contains("target_fields", n), F.col("seq"))).alias(n) for n in names]
    return kept.groupBy(key).agg(*last, F.max("lm_us").alias("lm_us"))


def is_plain(kind: Column, lm: Column, update: int, create: int) -> Column:
    """Whether a mutation sets columns at a known time; only such ones make a plain batch."""
    return kind.isin(update, create) & lm.isNotNull()


def fold_plain(events: DataFrame, stored: DataFrame | None, key: str, fields: list[T.StructField], create: int) -> DataFrame:
    """What ``fold`` gives, for plain events in its narrow form (key, seq, kind, lm, ev, set).

    A stored row is the first event of its key: it sets all columns and is always accepted.
    """
    rows = events.select(key, F.lit(1).alias("_rank"), "seq", (F.col("kind") == create).alias("_create"), "lm", "ev", "set")
    if stored is not None:
        held = F.struct(*[F.struct(F.col(f"_s_{f.name}").alias("v")).alias(f.name) for f in fields]).alias("set")
        first = stored.select(key, F.lit(0).alias("_rank"), F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), F.lit(False).alias("_create"), F.col("_lm").alias("lm"), F.col("_ev").alias("ev"), held)
        rows = rows.unionByName(first)
    in_order = Window.partitionBy(key).orderBy("_rank", "seq")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("_rank") == 0) | F.col("_create")
    rows = rows.withColumns({"_open": F.max(opens).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), "_was": F.coalesce(F.max(opens).over(before), F.lit(False))})
    # Events ahead of a key's first create change nothing.
    rows = rows.withColumn("_newest", F.max(F.when(F.col("_open"), F.col("lm"))).over(before))
    taken = F.col("_open") & ((F.col("_rank") == 0) | F.col("_newest").isNull() | (F.col("lm") >= F.col("_newest")))
    rows = rows.withColumn("_taken", taken)
    # The latest event time of the creates that came, too old, after the last accepted event.
    epoch = F.timestamp_micros(F.lit(0))
    later = Window.partitionBy(key).orderBy(F.col("_rank").desc(), F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_after", ~F.max("_taken").over(later))
    order, event = F.struct("_rank", "seq"), F.col("_rank") == 1
    stale = event & F.col("_open") & ~F.col("_taken") & F.col("_create")
    count = lambda c: F.count_if(c).cast("bigint")
    inserted, updated = event & F.col("_taken") & ~F.col("_was"), event & F.col("_taken") & F.col("_was")
    per_key = rows.groupBy(key).agg(
        F.max("_open").alias("present"),
        *[F.max_by(F.col("set")[f.name], F.when(F.col("_taken") & F.col("set")[f.name].isNotNull(), order)).alias(f"_v_{f.name}") for f in fields],
        F.max(F.when(F.col("_taken"), F.col("lm"))).alias("_m"),
        F.max_by(F.struct("ev"), F.when(F.col("_taken"), order)).alias("_e"),
        F.max(F.when(stale & F.col("_after"), F.coalesce("ev", epoch))).alias("_raised"),
        count(inserted).alias("inserted"), count(updated).alias("updated"), F.lit(0).cast("bigint").alias("deleted"), count(stale).alias("stale"),
        count(event & ~F.col("_taken") & ~(F.col("_open") & F.col("_create"))).alias("ignored"),
    )
    ev = F.when(F.col("_raised").isNull(), F.col("_e.ev")).otherwise(F.greatest(F.coalesce("_e.ev", epoch), F.col("_raised")))
    return per_key.select(
        key, "present", *[F.col(f"_v_{f.name}.v").alias(f.name) for f in fields], F.col("_m").alias(LAST_MODIFIED), ev.alias(LAST_EVENT),
        "inserted", "updated", "deleted", "stale", "ignored",
    )
