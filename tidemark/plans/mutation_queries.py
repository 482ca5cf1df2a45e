"""Checked queries of the mutation core: folds, guards, order, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import fold as K
from tidemark.operators.plain_fold import accept_flags, last_accepted
from tidemark.operators.skew import running
from tidemark.operators.snapshot import upsert_snapshot
from tidemark.plans import views as V
from tidemark.plans.checked import query
from tidemark.session import shared_folder
from tidemark.sources.store import KeyedTable
from tidemark.streaming.apply import apply_batch, bootstrap, events_by_type, initial_load, route_activity, type_order

#: Mutations of every key in order, as views.mutations derives them.
PLAIN = """
SELECT user_id AS k, event_id AS seq, epoch_us(ts) AS ev,
       epoch_us(ts) - (event_id % 7) * 86400000000 AS lm, value, props, event_type <> 'click' AS both_set, true AS some_set,
       CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'view' THEN 'UNDELETE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS t
FROM events
"""
SPARSE = f"""
SELECT k, seq, CASE WHEN value>=65 AND value<75 THEN NULL ELSE ev END AS ev,
       CASE WHEN value>=60 AND value<70 THEN NULL ELSE lm END AS lm, value, props, both_set, value >= 10 AS some_set, t
FROM ({PLAIN})
"""
SKEWED = f"SELECT * REPLACE (CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS k) FROM ({PLAIN})"
NOTICES = f"""
SELECT * REPLACE (CASE t WHEN 'DELETE' THEN 0 WHEN 'CREATE' THEN 1 WHEN 'UPDATE' THEN 2 END * 1000000000000 + seq AS seq)
FROM ({PLAIN}) WHERE t <> 'UNDELETE'
"""


def fold_sql(mutations: str, stored: str = "", tail: str = "") -> str:
    """The rules of the fold as a recursive query, one event of every key per step.

    ``stored`` gives start rows (k, lm, ev, value, props); ``tail`` selects from ``f``.
    """
    start = (
        f"SELECT k, 0 AS rn, true AS present, lm, ev, value, props, 0 AS seq, '' AS act FROM ({stored})"
        f" UNION ALL SELECT k, 0, false, NULL, NULL, NULL, NULL, 0, '' FROM (SELECT DISTINCT k FROM m)"
        f" WHERE k NOT IN (SELECT k FROM ({stored}))"
        if stored
        else "SELECT DISTINCT k, 0 AS rn, false AS present, CAST(NULL AS BIGINT) AS lm, CAST(NULL AS BIGINT) AS ev,"
        " CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS props, CAST(0 AS BIGINT) AS seq, '' AS act FROM m"
    )
    return f"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM ({mutations})),
f AS (
  {start}
  UNION ALL
  SELECT k, rn,
    CASE act WHEN 'deleted' THEN false WHEN 'inserted' THEN true ELSE present END,
    CASE act WHEN 'deleted' THEN NULL WHEN 'inserted' THEN CASE WHEN some_set THEN e_lm END
             WHEN 'updated' THEN e_lm ELSE lm END,
    CASE act WHEN 'deleted' THEN NULL WHEN 'inserted' THEN CASE WHEN some_set THEN e_ev END
             WHEN 'updated' THEN e_ev WHEN 'stale' THEN greatest(coalesce(ev,0), coalesce(e_ev,0)) ELSE ev END,
    CASE WHEN act='deleted' THEN NULL WHEN act IN ('inserted','updated') AND some_set THEN e_value
         WHEN act='inserted' THEN NULL ELSE value END,
    CASE WHEN act='deleted' THEN NULL WHEN act IN ('inserted','updated') AND some_set AND both_set THEN e_props
         WHEN act='inserted' THEN NULL ELSE props END,
    seq, act
  FROM (
    SELECT f.k, m.rn, f.present, f.lm, f.ev, f.value, f.props, m.lm AS e_lm, m.ev AS e_ev, m.value AS e_value,
      m.props AS e_props, m.both_set, m.some_set, m.seq,
      CASE WHEN m.t='DELETE' THEN CASE WHEN f.present AND (f.ev IS NULL OR f.ev <= m.ev) THEN 'deleted' ELSE 'ignored' END
           WHEN NOT m.some_set THEN CASE WHEN m.t IN ('CREATE','UNDELETE') AND NOT f.present THEN 'inserted' ELSE 'ignored' END
           WHEN f.present AND (m.lm IS NULL OR f.lm IS NULL OR f.lm <= m.lm) THEN 'updated'
           WHEN m.t = 'UPDATE' THEN 'ignored'
           WHEN f.present THEN 'stale' ELSE 'inserted' END AS act
    FROM f JOIN m ON m.k = f.k AND m.rn = f.rn + 1))
{tail}
"""


ROWS_TAIL = """
SELECT k AS sfid, value, props, lm AS lm_us, ev AS ev_us FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY rn DESC) AS back FROM f) WHERE back = 1 AND present
"""
COUNTS_TAIL = """
SELECT count(*) FILTER (act='inserted') AS inserted, count(*) FILTER (act='updated') AS updated,
       count(*) FILTER (act='deleted') AS deleted, count(*) FILTER (act='stale') AS stale,
       count(*) FILTER (act='ignored') AS ignored, count(*) AS received FROM f WHERE rn > 0
"""


def _rows(applied: DataFrame) -> DataFrame:
    return applied.select(
        "sfid", "value", "props",
        V.micros("_oc_last_modified_at").alias("lm_us"), V.micros("_oc_last_event_at").alias("ev_us"),
    )


@query("guarded_fold_rows", "K3 K4 K5 K6 K9 K10 T2 T3 W1 S9", fold_sql(PLAIN, tail=ROWS_TAIL))
def guarded_fold_rows(spark, sf_dir):
    return _rows(K.apply_mutations(V.mutations(spark, sf_dir)))


@query("guarded_fold_counts", "A9", fold_sql(PLAIN, tail=COUNTS_TAIL))
def guarded_fold_counts(spark, sf_dir):
    return K.mutation_counts(K.fold(V.mutations(spark, sf_dir)))


@query("guarded_fold_bare_and_untimed", "K7 K8 K5 K9 P18", fold_sql(SPARSE, tail=ROWS_TAIL))
def guarded_fold_sparse(spark, sf_dir):
    return _rows(K.apply_mutations(V.sparse_mutations(spark, sf_dir)))


@query("guarded_fold_bare_and_untimed_counts", "K7 K8 A9", fold_sql(SPARSE, tail=COUNTS_TAIL))
def guarded_fold_sparse_counts(spark, sf_dir):
    return K.mutation_counts(K.fold(V.sparse_mutations(spark, sf_dir)))


#: Small enough for the shared key of the skewed events to take the segmented path.
HOT_LIMIT = 1000


@query("guarded_fold_hot_key", "K3 K5 K9 T2", fold_sql(SKEWED, tail=ROWS_TAIL))
def guarded_fold_hot_key(spark, sf_dir):
    return _rows(K.apply_mutations(V.skewed_mutations(spark, sf_dir), limit=HOT_LIMIT, segment_rows=HOT_LIMIT))


STORED = """
SELECT c_custkey AS k, 1704067200000000 + (c_custkey % 30) * 86400000000 AS lm,
       1704067200000000 + (c_custkey % 20) * 86400000000 AS ev, c_acctbal AS value, c_name AS props FROM customer
"""


@query("guarded_fold_over_stored_rows", "K3 K9 J3 T5", fold_sql(PLAIN, STORED, ROWS_TAIL))
def guarded_fold_over_stored(spark, sf_dir):
    return _rows(K.apply_mutations(V.mutations(spark, sf_dir), V.customer_rows(spark, sf_dir)))


#: Batches the events are committed in.
BATCHES = 4


@query("store_applied", "S9 T2 T5 T10 K3 K9", fold_sql(PLAIN, STORED, ROWS_TAIL))
def store_applied(spark, sf_dir):
    """A stored table: snapshot, event batches, and a replay of each kind, which changes nothing."""
    stored, m = V.customer_rows(spark, sf_dir), V.mutations(spark, sf_dir).withColumn("reject_reason", F.lit(None).cast("string"))
    table = KeyedTable(spark, shared_folder(spark, "tables"), stored.schema, buckets=8)
    bootstrap(table, stored, "snapshot-1")
    width = m.agg(F.floor(F.max("seq") / BATCHES) + 1).scalar()
    for n in range(BATCHES):
        apply_batch(table, m.where(F.floor(F.col("seq") / width) == n), f"route-{n}")
    if apply_batch(table, m, f"route-{BATCHES - 1}") or bootstrap(table, stored, "snapshot-1"):
        raise RuntimeError("a replayed batch was applied again")
    return _rows(table.read())


@query(
    "initial_load", "A14 T5",
    f"""SELECT 'snapshot-1' AS batch, unnest([true, false]) AS applied, n AS row_count, true AS timed
        FROM (SELECT count(*) AS n FROM ({STORED}))""",
)
def initial_load_(spark, sf_dir):
    """The report of a snapshot's load, and of its repetition, which changes nothing."""
    stored = V.customer_rows(spark, sf_dir)
    table = KeyedTable(spark, shared_folder(spark, "tables"), stored.schema, buckets=8)
    reports = initial_load(table, stored, "snapshot-1").union(initial_load(table, stored, "snapshot-1"))
    return reports.select("batch", "applied", "row_count", (F.col("duration_ms") >= 0).alias("timed"))


@query("notice_fold_by_type", "T7 P4", fold_sql(NOTICES, tail=ROWS_TAIL))
def notice_fold_by_type(spark, sf_dir):
    m = V.mutations(spark, sf_dir).where("change_type <> 'UNDELETE'")
    m = m.withColumn("seq", type_order(F.col("change_type"), F.col("seq")))
    return _rows(K.apply_mutations(m))


@query(
    "mutation_kinds", "K7 K8 K10",
    f"""SELECT t AS change_type, CASE WHEN t='DELETE' THEN 0 WHEN t IN ('CREATE','UNDELETE') AND some_set THEN 2
           WHEN t IN ('CREATE','UNDELETE') THEN 3 WHEN some_set THEN 1 ELSE 4 END AS kind, count(*) AS n
        FROM ({SPARSE}) GROUP BY 1, 2""",
)
def mutation_kinds(spark, sf_dir):
    m = V.sparse_mutations(spark, sf_dir)
    return m.groupBy("change_type", K.kind(F.col("change_type"), F.col("target_fields")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


_FLAGS = f"""
SELECT *, coalesce(lm >= max(lm) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted
FROM ({{m}}) WHERE t <> 'DELETE'
"""


@query("accept_flags", "W2", f"SELECT k AS sfid, seq, accepted FROM ({_FLAGS.format(m=PLAIN)})")
def accept_flags_query(spark, sf_dir):
    m = V.mutations(spark, sf_dir).where("change_type <> 'DELETE'")
    return accept_flags(m).select("sfid", "seq", "accepted")


@query("accept_flags_hot_key", "W2", f"SELECT k AS sfid, seq, accepted FROM ({_FLAGS.format(m=SKEWED)})")
def accept_flags_hot(spark, sf_dir):
    m = V.skewed_mutations(spark, sf_dir).where("change_type <> 'DELETE'")
    return accept_flags(m, limit=HOT_LIMIT, segment_rows=HOT_LIMIT).select("sfid", "seq", "accepted")


@query(
    "last_accepted_values", "W3",
    f"""SELECT k AS sfid, max_by(value, seq) AS value, max_by(props, seq) FILTER (both_set) AS props, max(lm) AS lm_us
        FROM ({_FLAGS.format(m=PLAIN)}) WHERE accepted GROUP BY k""",
)
def last_accepted_values(spark, sf_dir):
    return last_accepted(V.mutations(spark, sf_dir).where("change_type <> 'DELETE'"))


#: Batches without deletes and missing times: the one kind in which every event sets something.
UNDELETED = f"SELECT * FROM ({PLAIN}) WHERE t <> 'DELETE'"


@query("plain_fold_rows", "W2 W3 K3 K5", fold_sql(UNDELETED, tail=ROWS_TAIL))
def plain_fold_rows(spark, sf_dir):
    """Folded by running maxima, as nothing in the batch deletes or misses a time."""
    return _rows(K.apply_mutations(V.mutations(spark, sf_dir).where("change_type <> 'DELETE'"), plain=True))


@query("plain_fold_over_stored_rows", "W2 W3 K3 K6 J3", fold_sql(UNDELETED, STORED, ROWS_TAIL))
def plain_fold_over_stored(spark, sf_dir):
    return _rows(K.apply_mutations(V.mutations(spark, sf_dir).where("change_type <> 'DELETE'"), V.customer_rows(spark, sf_dir)))


@query("plain_fold_counts", "W2 A9 K6", fold_sql(UNDELETED, STORED, COUNTS_TAIL))
def plain_fold_counts(spark, sf_dir):
    return K.mutation_counts(K.fold(V.mutations(spark, sf_dir).where("change_type <> 'DELETE'"), V.customer_rows(spark, sf_dir)))


@query("plain_fold_hot_key", "W2 W3 K3", fold_sql(f"SELECT * FROM ({SKEWED}) WHERE t <> 'DELETE'", tail=ROWS_TAIL))
def plain_fold_hot_key(spark, sf_dir):
    m = V.skewed_mutations(spark, sf_dir).where("change_type <> 'DELETE'")
    return _rows(K.apply_mutations(m, limit=HOT_LIMIT, segment_rows=HOT_LIMIT))


@query(
    "event_order_in_key", "W1",
    "SELECT user_id AS sfid, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events",
)
def event_order(spark, sf_dir):
    m = V.mutations(spark, sf_dir).select("sfid", "seq")
    one = {"place": ("sum", F.lit(1).cast("bigint"))}
    return running(m, ["sfid"], ["seq"], one)


@query(
    "events_batched_by_type", "A8 T1",
    """SELECT epoch_us(ts) // 3600000000 AS batch, event_type, event_id AS seq,
              row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000, event_type ORDER BY event_id) AS position FROM events""",
)
def events_batched_by_type(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    hour = F.floor(V.micros("ts") / F.lit(3_600_000_000)).cast("bigint")
    return events_by_type(e.select(hour.alias("batch"), "event_type", F.col("event_id").alias("seq")))


@query(
    "route_activity", "T9",
    "SELECT user_id AS sfid, max(epoch_us(ts)) AS last_event_us FROM events GROUP BY user_id",
)
def route_activity_query(spark, sf_dir):
    out = route_activity(V.mutations(spark, sf_dir), "sfid")
    return out.select("sfid", F.unix_micros("last_event_at").alias("last_event_us"))


_SNAPSHOTS = """
WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS amount, min(o_orderstatus) AS status,
                  max(epoch_us(o_orderdate)) AS us, min(epoch_us(o_orderdate)) AS ev FROM orders
           WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
n AS (SELECT o_custkey AS k, max(o_totalprice) AS amount, max(o_orderstatus) AS status,
             max(epoch_us(o_orderdate)) AS us, min(epoch_us(o_orderdate)) AS ev FROM orders
      WHERE o_orderpriority = '5-LOW' GROUP BY 1),
j AS (SELECT o.k IS NOT NULL AS has_o, n.k IS NOT NULL AS has_n, coalesce(o.k, n.k) AS k,
        o.amount AS oa, n.amount AS na, o.status AS os, n.status AS ns, o.ev AS oe, n.ev AS ne,
        CASE WHEN o.amount > 20000 THEN o.us END AS ol, CASE WHEN n.amount > 20000 THEN n.us END AS nl
      FROM o FULL OUTER JOIN n ON o.k = n.k),
s AS (SELECT *, NOT has_o OR (has_n AND (nl IS NULL OR ol IS NULL OR nl >= ol)) AS take FROM j)
SELECT k AS sfid, CASE WHEN take THEN na ELSE oa END AS amount, CASE WHEN take THEN ns ELSE os END AS status,
"""


def _snapshot_rows(spark, sf_dir, guard):
    stored, incoming = V.snapshots(spark, sf_dir)
    out = upsert_snapshot(stored, incoming, guard=guard)
    return out.select(
        "sfid", "amount", "status", V.micros("_oc_last_modified_at").alias("lm_us"),
        V.micros("_oc_last_event_at").alias("ev_us"),
    )


@query(
    "snapshot_upsert_column_guard", "K1 J3 P21",
    _SNAPSHOTS + """
  CASE WHEN has_o AND has_n THEN greatest(coalesce(ol,0), coalesce(nl,0)) ELSE coalesce(ol,nl) END AS lm_us,
  CASE WHEN has_o AND has_n THEN greatest(coalesce(oe,0), coalesce(ne,0)) ELSE coalesce(oe,ne) END AS ev_us FROM s""",
)
def snapshot_upsert_column_guard(spark, sf_dir):
    return _snapshot_rows(spark, sf_dir, "column")


@query(
    "snapshot_upsert_row_guard", "K2 J3",
    _SNAPSHOTS + """
  CASE WHEN NOT has_o THEN nl WHEN has_n AND take THEN coalesce(nl,ol) ELSE ol END AS lm_us,
  CASE WHEN NOT has_o THEN ne WHEN has_n AND take THEN coalesce(ne,oe) ELSE oe END AS ev_us FROM s""",
)
def snapshot_upsert_row_guard(spark, sf_dir):
    return _snapshot_rows(spark, sf_dir, "row")
