"""Checked queries of tables that batches and streams change: sinks, routes, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.columns import KEY, LAST_EVENT, LAST_MODIFIED
from tidemark.operators import files as B
from tidemark.operators import normalize as N
from tidemark.operators import registry as R
from tidemark.plans import views as V
from tidemark.plans.checked import query
from tidemark.plans.event_queries import _CHANGES, table_schema
from tidemark.plans.file_queries import _FILES, _OUT, _outcomes, _plan_sql
from tidemark.plans.mutation_queries import PLAIN, ROWS_TAIL, SPARSE, STORED, _rows, fold_sql
from tidemark.plans.registry_queries import UPSERTED_ROUTES, upserted_columns
from tidemark.session import shared_folder
from tidemark.sources.feeds import file_feed
from tidemark.sources.store import KeyedTable, upsert_into
from tidemark.streaming.apply import apply_batch, apply_waiting, bootstrap, drop_route, start_routes
from tidemark.streaming.state import current_rows, row_changes, stateful_session


@query("routes_sunk", "S10 K11", UPSERTED_ROUTES)
def routes_sunk(spark, sf_dir):
    """Routes registered into a stored table: a load, then every registration as one multi-row upsert, twice sent."""
    routes, new = V.routes(spark, sf_dir), V.registrations(spark, sf_dir)
    table = KeyedTable(spark, shared_folder(spark, "tables"), routes.schema, buckets=8, key=R.ROUTE_KEY)
    table.commit("seed-0", routes, lambda old: routes)

    def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        return R.upsert_routes(stored, incoming, V.now(), order="o_orderkey")

    if not upsert_into(table, "registrations-0", new, upsert) or upsert_into(table, "registrations-0", new, upsert):
        raise RuntimeError("a batch has to be applied once")
    return upserted_columns(table.read())


@query("route_dropped", "S13", fold_sql(f"SELECT * FROM ({PLAIN}) WHERE k % 2 = 0", f"SELECT * FROM ({STORED}) WHERE k % 2 = 0", ROWS_TAIL))
def route_dropped(spark, sf_dir):
    """Two routes' tables, loaded and changed; one of them and its data are dropped, the other one is as it was."""
    m = V.mutations(spark, sf_dir).withColumn("reject_reason", F.lit(None).cast("string"))
    stored, left = V.customer_rows(spark, sf_dir), []
    for k in (0, 1):
        mine = F.pmod(F.col(KEY), F.lit(2)) == k
        table, out = KeyedTable(spark, shared_folder(spark, "tables"), stored.schema, buckets=4), shared_folder(spark, "outcomes")
        bootstrap(table, stored.where(mine), "snapshot-1")
        apply_batch(table, m.where(mine), "route-0", out)
        if k == 1:
            drop_route(table, out)
        left.append(table.read())
    return _rows(left[0].unionByName(left[1]))


def _routed(spark, sf_dir, feed: str) -> DataFrame:
    """The stream of the change feed's mutations by route, an object a route; only one route has faulty events."""
    out = N.typed(N.normalize_changes(file_feed(spark, feed, fmt="parquet"), V.CHANGE_FIELDS, V.now()), V.CHANGE_FIELDS)
    route = F.concat(F.lit("object "), F.pmod(F.coalesce(F.col(KEY).cast("bigint"), F.lit(1)), F.lit(3)).cast("string"))
    return out.withColumn("route", route).where("reject_reason is null or route = 'object 1'")


@query("routes_streamed", "T4 T6 T10", fold_sql(_CHANGES, tail=ROWS_TAIL.replace("SELECT k AS", "SELECT 'object '||(CAST(k AS BIGINT)%3) AS route, k AS")))
def routes_streamed(spark, sf_dir):
    """Three routes in one streaming query. One refuses its first batch for its faulty events while
    the others go on; after a restart that takes them, it catches up in order."""
    feed, checkpoint, waiting, path = (shared_folder(spark, kind) for kind in ("feeds", "routes", "waiting", "tables"))
    events = V.change_feed(spark, sf_dir)
    half = events.agg(F.floor(F.max("seq") / 2)).scalar()
    for part, strict in ((F.col("seq") <= half, True), (F.col("seq") > half, False)):
        events.where(part).write.mode("append").parquet(feed)
        mutations = _routed(spark, sf_dir, feed)
        schema = table_schema(mutations)

        def table(route: str, schema: T.StructType = schema) -> KeyedTable:
            return KeyedTable(spark, f"{path}/{route}", schema, buckets=4)

        start_routes(mutations, "route", table, checkpoint, waiting, available_now=True, strict=strict).awaitTermination()
    if apply_waiting(spark, mutations.schema, "route", table, waiting):
        raise RuntimeError("a route is still waiting")
    rows = None
    for k in range(3):
        one = table(f"object {k}").read().withColumn("route", F.lit(f"object {k}"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select(
        "route", KEY, F.col("Amount").alias("value"), F.col("Note").alias("props"), V.micros(LAST_MODIFIED).alias("lm_us"), V.micros(LAST_EVENT).alias("ev_us"),
    )


#: Files the events of a stateful stream come in.
PARTS = 4


def _stateful(spark, mutations: DataFrame) -> DataFrame:
    """The rows that a stateful stream over the mutations leaves, stopped and restarted half way."""
    own = stateful_session(spark)
    feed, checkpoint, path = (shared_folder(spark, kind) for kind in ("feeds", "routes", "changes"))
    width = mutations.agg(F.floor(F.max("seq") / PARTS) + 1).scalar()
    part = F.floor(F.col("seq") / width)
    for first in range(0, PARTS, 2):
        for n in (first, first + 1):
            mutations.where(part == n).coalesce(1).write.mode("append").parquet(feed)
        # Each file is a batch of its own.
        stream = own.readStream.schema(mutations.schema).option("maxFilesPerTrigger", 1).parquet(feed)
        changes = row_changes(stream)
        sink = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _rows(current_rows(spark.read.schema(changes.schema).parquet(path)))


@query("state_processor_rows", "T2 T3 T6 K3 K5 K9 W1", fold_sql(PLAIN, tail=ROWS_TAIL))
def state_processor_rows(spark, sf_dir):
    return _stateful(spark, V.mutations(spark, sf_dir))


@query("state_processor_bare_and_untimed", "T2 T3 K7 K8", fold_sql(SPARSE, tail=ROWS_TAIL))
def state_processor_sparse(spark, sf_dir):
    return _stateful(spark, V.sparse_mutations(spark, sf_dir))


@query(
    "upload_summary_file", "S12 A10",
    _plan_sql(_FILES, _OUT + """SELECT path, success, message, (SELECT count(*) FROM x) AS total_count,
      (SELECT count(*) FROM x WHERE success) AS success_count, (SELECT count(*) FROM x WHERE NOT success) AS failure_count FROM x"""),
)
def upload_summary_file(spark, sf_dir):
    """The files of a run's summary, read back: every item beside the totals."""
    folder = shared_folder(spark, "summaries")
    B.write_summary(_outcomes(spark, sf_dir).select("root", "path", "batch_no", "position", "success", "message"), folder, "run")
    totals = spark.read.schema("total_count bigint, success_count bigint, failure_count bigint").option("multiLine", True).json(f"{folder}/upload-run.json")
    items = spark.read.schema("path string, success boolean, message string").json(f"{folder}/items-run")
    return items.withColumns({c: totals.select(c).scalar() for c in totals.columns})
