"""Splitting ordered groups that are too large for one task.

Work that depends on the order of rows inside a group (a fold, a running sum) is
normally one task per group. A group with more rows than ``limit`` is cut into
contiguous *segments* by a range partitioning on (keys, order): the rows of one hot
group then lie in many partitions, each a consecutive run of its rows. A job
summarises the segments in parallel, scans the few summaries per group, and replays
the segments in parallel from the state each one starts with.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, keep_partitions, small_side

#: Rows of one group that a single task may hold.
GROUP_LIMIT = 10_000
#: Rows of one segment, which a task streams through.
SEGMENT_ROWS = 1_000_000
SEGMENT = "_segment"


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows of groups within the limit, rows of larger groups, keys of those).

    The last two are None when every group is within the limit.
    """
    return split_and_test(df, keys, limit, F.lit(True))[:3]


def split_and_test(
    df: DataFrame, keys: Sequence[str], limit: int, test: Column
) -> tuple[DataFrame, DataFrame | None, DataFrame | None, bool]:
    """``split_hot``, and whether ``test`` holds for all rows, in the same pass."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(test).alias("_fine"))
    figures = sizes.agg(F.max("_n").alias("most"), F.min("_fine").alias("fine")).first()
    fine = figures.fine is not False
    if (figures.most or 0) <= limit:
        return df, None, None, fine
    hot = cut_lineage(sizes.where(F.col("_n") > limit).select(*keys))
    hot = small_side(hot, hot.count())
    return on_keys(df, hot, keys, "left_anti"), on_keys(df, hot, keys, "left_semi"), hot, fine


def on_keys(df: DataFrame, some: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys that may be null."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return df.alias("l").join(some.alias("r"), same, how)


def segment(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Range-partition on (keys, order), sort, and number the partitions.

    The result is checkpointed in place: the segment number comes from sampled range bounds,
    so it has to be fixed for all jobs that rely on it, and so has the order.
    """
    parts = max(1, math.ceil(df.count() / rows))
    cut = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    return keep_partitions(cut.withColumn(SEGMENT, F.spark_partition_id()))


def in_order(df: DataFrame, name: str = "place") -> DataFrame:
    """The rows of an ordered DataFrame with their position in it, from 1.

    Rows are numbered inside the partitions of the sort, and a partition's offset comes from
    one row per partition: no window over all rows.
    """
    numbered = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(offsets, part == F.col("_part")).select(*df.columns, place.alias(name))


def numbered_in(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The rows with their position in their group, from 0, for groups of any size without nulls in their keys.

    Rows are dealt out by range, written with the number of their part, and numbered inside it;
    a group's offset in a part comes from one row per group and part.
    """
    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    offsets = sizes.select(*keys, "_part", before.alias("_before"))
    placed = dealt.withColumn("_place", place).join(offsets, [*keys, "_part"])
    return placed.select(*df.columns, (F.col("_before") + F.col("_place") - 1).alias(name))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    limit: int = SEGMENT_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Running ``sum`` or ``max`` per group in order, for groups of any size.

    ``totals`` maps an output name to (``"sum"`` | ``"max"``, value column). An exclusive
    running value covers the rows strictly before the current one and is null at the start.
    A window spills, so groups of up to ``limit`` rows are left to one.
    """
    end = 0 if inclusive else -1
    cold, hot, _ = split_hot(df, keys, limit) if keys else (None, df, None)
    if not keys and df.count() <= limit:
        cold, hot = df, None
    aggregate = {"sum": F.sum, "max": F.max}

    def local(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return rows.select("*", *[aggregate[f](v).over(w).alias(n) for n, (f, v) in totals.items()])

    parts = [] if cold is None else [local(cold, keys)]
    if hot is not None:
        cut = segment(hot, keys, order, segment_rows)
        per_segment = cut.groupBy(*keys, SEGMENT).agg(
            *[aggregate[f](v).alias(f"_p_{n}") for n, (f, v) in totals.items()]
        )
        before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_segment.select(
            *[F.col(k).alias(f"_o_{k}") for k in keys],
            F.col(SEGMENT).alias("_o_segment"),
            *[aggregate[f](f"_p_{n}").over(before).alias(f"_b_{n}") for n, (f, _) in totals.items()],
        )
        same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
        same.append(F.col(SEGMENT) == F.col("_o_segment"))
        joined = local(cut, [*keys, SEGMENT]).join(offsets, same)
        # greatest() skips nulls; a sum with a missing side is the other side.
        value = {
            n: F.greatest(F.col(n), F.col(f"_b_{n}"))
            if f == "max"
            else F.coalesce(F.col(n) + F.col(f"_b_{n}"), F.col(n), F.col(f"_b_{n}"))
            for n, (f, _) in totals.items()
        }
        parts.append(joined.select(*df.columns, *[v.alias(n) for n, v in value.items()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
