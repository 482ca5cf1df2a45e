"""Streaming apply of change feeds to keyed tables.

The target row is the state: no watermark, the freshness guards decide about late and
repeated events. Each micro-batch is folded like a batch job and applied under its batch id,
so a restart from the checkpoint neither loses nor repeats one. Rejected events go to a
table beside it. A route may have a streaming query of its own (``start_route``), or all
routes share one (``start_routes``), which applies each batch route by route.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.fold import COUNTERS, fold
from tidemark.operators.normalize import accepted, rejected
from tidemark.operators.skew import GROUP_LIMIT, running
from tidemark.operators.snapshot import upsert_snapshot
from tidemark.session import delete_folder, subfolders, temporary_tables, use_utc
from tidemark.sources.store import KeyedTable

# Fixed value: how often a feed is applied.
TRIGGER = "5 seconds"
#: Order of event types inside a notification batch: deletes, then creates, then updates.
_TYPE_RANK = {"DELETE": 0, "CREATE": 1, "UNDELETE": 1, "UPDATE": 2}


def type_order(change_type: Column, seq: Column) -> Column:
    """``seq`` with the type rank in its top bits, for feeds batched by type.

    Needs ``seq`` below 2^60.
    """
    rank = F.lit(3).cast("bigint")
    for name, n in _TYPE_RANK.items():
        rank = F.when(change_type == name, F.lit(n).cast("bigint")).otherwise(rank)
    return F.shiftleft(rank, 60).bitwiseOR(seq)


def bootstrap(table: KeyedTable, snapshot: DataFrame, batch: str, guard: str = "column") -> bool:
    """Load a snapshot into the target (T5).

    Start the feed at an offset before the snapshot: events in both are stale and harmless.
    """
    return table.commit(batch, snapshot, lambda old: upsert_snapshot(old, snapshot, table.key, guard))


def initial_load(table: KeyedTable, snapshot: DataFrame, batch: str, guard: str = "column") -> DataFrame:
    """Bootstrap, and report one row: whether it was applied, the target's rows, its duration."""
    start = time.monotonic()
    done = bootstrap(table, snapshot, batch, guard)
    took = int(1000 * (time.monotonic() - start))
    report = [(batch, done, table.count(), took)]
    return snapshot.sparkSession.createDataFrame(report, "batch string, applied boolean, row_count bigint, duration_ms bigint")


def drop_route(table: KeyedTable, *folders: str) -> None:
    """Remove a route's target and its data: checkpoint, rejects and counts folders.

    The route's streaming query has to be stopped before.
    """
    table.drop()
    for folder in folders:
        delete_folder(table.spark, folder)


def apply_batch(
    table: KeyedTable,
    mutations: DataFrame,
    batch: str,
    out: str | None = None,
    limit: int = GROUP_LIMIT,
    strict: bool = False,
) -> bool:
    """Fold one batch of typed mutations into the target, all or nothing.

    With ``out``, the rejected events and the batch counters (A9) are written below it, each in
    a folder of the batch, which a replay replaces. With ``strict``, a batch that holds a
    rejected event raises ``ValueError`` and nothing of it is applied.
    """
    if table.is_applied(batch):
        return False
    spark = mutations.sparkSession
    if not table.is_staged(batch):
        with temporary_tables(spark):
            # Normalised once; what follows reads columns of it.
            path = f"{table.staging(batch)}/mutations"
            mutations.write.mode("overwrite").parquet(path)
            written = spark.read.schema(mutations.schema).parquet(path)
            if out:
                rejected(written).write.mode("overwrite").parquet(f"{out}/rejects/batch={batch}")
            if strict and not rejected(written).isEmpty():
                delete_folder(spark, table.staging(batch))
                raise ValueError(f"batch {batch} holds rejected events")
            count = {c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint") for c in COUNTERS}
            counted = table.stage(batch, accepted(written), lambda old: fold(accepted(written), old, table.key, limit), count)
        if out:
            row = {**counted, "received": sum(counted.values())}
            counts = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} bigint" for n in row))
            counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/batch={batch}")
    table.publish(batch)
    return True


def start_route(
    mutations: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    out: str | None = None,
    by_type: bool = False,
    available_now: bool = False,
    name: str | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    limit: int = GROUP_LIMIT,
    strict: bool = False,
) -> StreamingQuery:
    """One streaming query per route over its normalised, typed mutations.

    Normalise before this call: the expressions are then planned once, not per batch.
    """
    if by_type:
        mutations = mutations.withColumn("seq", type_order(F.col("change_type"), F.col("seq")))

    def run(batch: DataFrame, batch_id: int) -> None:
        apply_batch(table, batch, f"{name or 'route'}-{batch_id}", out, limit, strict)
        if on_batch:
            on_batch(batch, batch_id)

    return _start(mutations, run, checkpoint, name, available_now)


def _start(mutations: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, name: str | None, available_now: bool) -> StreamingQuery:
    use_utc(mutations.sparkSession)
    writer = mutations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)
    return writer.start()


def start_routes(
    mutations: DataFrame,
    route: str,
    open_table: Callable[[str], KeyedTable],
    checkpoint: str,
    waiting: str,
    out: str | None = None,
    available_now: bool = False,
    name: str | None = None,
    limit: int = GROUP_LIMIT,
    strict: bool = False,
) -> StreamingQuery:
    """One streaming query for all routes; ``route`` is the column that names an event's route (T4).

    A batch is written once, by route, to the folder ``waiting``, and then applied to each
    route's table, in the order of the batches. A route whose batch fails keeps it there, with
    all its later ones, and is tried again with the next batch or by ``apply_waiting``; the
    others go on. Only the names of routes reach the driver.
    """
    spark = mutations.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(route).parquet(f"{waiting}/batch={batch_id:012d}")
        apply_waiting(spark, mutations.schema, route, open_table, waiting, out, limit, strict)

    return _start(mutations, run, checkpoint, name, available_now)


def apply_waiting(
    spark,
    schema,
    route: str,
    open_table: Callable[[str], KeyedTable],
    waiting: str,
    out: str | None = None,
    limit: int = GROUP_LIMIT,
    strict: bool = False,
) -> dict[str, str]:
    """Apply the waiting batches of every route in order; the errors of the routes that failed."""
    failed: dict[str, str] = {}
    for folder in subfolders(spark, waiting):
        batch = int(folder.partition("=")[2])
        rows = spark.read.schema(schema).parquet(f"{waiting}/{folder}")
        names = [r[0] for r in rows.select(route).distinct().orderBy(route).collect()]
        done = True
        for one in names:
            table = open_table(one)
            last = table.last_batch("route")
            if last is not None and int(last.rpartition("-")[2]) >= batch:
                continue
            if one not in failed:
                try:
                    to = f"{out}/route={one}" if out else None
                    apply_batch(table, rows.where(F.col(route).eqNullSafe(F.lit(one))).drop(route), f"route-{batch}", to, limit, strict)
                    continue
                except Exception as e:  # the route waits, the others go on
                    failed[one] = str(e)
            done = False
        if done:
            delete_folder(spark, f"{waiting}/{folder}")
    if out:
        report = spark.createDataFrame([(k, v) for k, v in failed.items()], "route string, error string")
        report.coalesce(1).write.mode("overwrite").parquet(f"{out}/failed")
    return failed


def route_activity(mutations: DataFrame, route: str) -> DataFrame:
    """Latest event time per route (T9); also a streaming aggregation, in update mode."""
    return mutations.groupBy(route).agg(F.max("ev").alias("last_event_at"))


def events_by_type(events: DataFrame, batch: str = "batch") -> DataFrame:
    """Bodies of a batch per event type, in arrival order.

    One row per event: ``position`` within its batch and type. A list per type would hold
    the whole batch in one row.
    """
    one = {"position": ("sum", F.lit(1).cast("bigint"))}
    return running(events, [batch, "event_type"], ["seq"], one)
