"""Upsert of a full snapshot into a target table.

One full outer join on the key. A target bucketed or partitioned by the key is not
shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.columns import KEY, LAST_EVENT, LAST_MODIFIED


def snapshot_rows(typed_records: DataFrame, key: str = KEY) -> DataFrame:
    """Typed records as target rows."""
    return typed_records.select(
        key, "vals.*", F.col("lm").alias(LAST_MODIFIED), F.col("ev").alias(LAST_EVENT)
    )


def _later(old: Column, new: Column) -> Column:
    epoch = F.timestamp_micros(F.lit(0))
    return F.greatest(F.coalesce(old, epoch), F.coalesce(new, epoch))


def one_per_key(incoming: DataFrame, key: str = KEY, order: str | None = None) -> DataFrame:
    """Incoming rows of a key applied to each other, by ``order`` or as they come.

    The last row that is not older than those before it gives the values, the times are the
    latest of all. A window on the key, which the join that follows needs anyway.
    """
    rows = incoming.withColumn("_order", F.col(order) if order else F.monotonically_increasing_id())
    before = Window.partitionBy(key).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(LAST_MODIFIED).over(before)
    fresh = F.col(LAST_MODIFIED).isNull() | seen.isNull() | (F.col(LAST_MODIFIED) >= seen)
    backward = Window.partitionBy(key).orderBy(F.col("_order").desc())
    latest = Window.partitionBy(key)
    last = rows.withColumn("_fresh", fresh).withColumns({f"_m_{c}": F.max(c).over(latest) for c in (LAST_MODIFIED, LAST_EVENT)}).where("_fresh")
    last = last.withColumn("_place", F.row_number().over(backward)).where("_place = 1")
    return last.select(*[F.col(f"_m_{c}").alias(c) if c in (LAST_MODIFIED, LAST_EVENT) else F.col(c) for c in incoming.columns])


def upsert_snapshot(
    target: DataFrame, incoming: DataFrame, key: str = KEY, guard: str = "column", order: str | None = None
) -> DataFrame:
    """The target after the snapshot, in which a key may occur several times.

    A present row takes the incoming values unless its last-modified time is later.
    ``guard="column"``: the two time columns become the later of both sides, whether or not
    the values were taken (null counts as 1970). ``guard="row"``: a stale incoming row
    changes nothing, a fresh one sets the times it has.
    """
    if guard not in ("column", "row"):
        raise ValueError(f"unknown guard {guard!r}")
    old = target.withColumn("_old", F.lit(True)).alias("o")
    new = one_per_key(incoming, key, order).withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    old_lm, new_lm = F.col(f"o.{LAST_MODIFIED}"), F.col(f"n.{LAST_MODIFIED}")
    fresh = new_lm.isNull() | old_lm.isNull() | (new_lm >= old_lm)
    take_new = F.col("_old").isNull() | (F.col("_new").isNotNull() & fresh)

    def value(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            return F.coalesce(o, n)
        if c not in (LAST_MODIFIED, LAST_EVENT):
            return F.when(take_new, n).otherwise(o)
        if guard == "column":
            return F.when(both, _later(o, n)).otherwise(F.coalesce(o, n))
        return F.when(both & fresh, F.coalesce(n, o)).when(both, o).otherwise(F.coalesce(o, n))

    return joined.select(*[value(c).alias(c) for c in target.columns])
