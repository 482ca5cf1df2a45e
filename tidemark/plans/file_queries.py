"""Checked queries of file batches, uploads and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import files as B
from tidemark.operators.skew import in_order
from tidemark.plans import views as V
from tidemark.plans.checked import query
from tidemark.sources.store import row_count

#: The documents are small, so a smaller byte limit than the usual one makes both limits bind.
BYTES = 40_000
#: Small enough for one root's files to need several blocks.
SEGMENT_FILES = 300

_FILES = "SELECT source AS root, '/'||source||'/'||lpad(CAST(doc_id AS VARCHAR),12,'0') AS path, strlen(text) AS size, doc_id FROM documents"
_ONE_ROOT = f"SELECT '/' AS root, path, size, doc_id FROM ({_FILES})"


def _plan_sql(files: str, tail: str) -> str:
    return f"""
WITH RECURSIVE m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS rn FROM ({files})),
f AS (SELECT root, rn, path, size, doc_id, CAST(0 AS BIGINT) AS batch_no, CAST(0 AS BIGINT) AS position, CAST(size AS BIGINT) AS used FROM m WHERE rn=1
  UNION ALL
  SELECT root, rn, path, size, doc_id, batch_no + CASE WHEN new THEN 1 ELSE 0 END, CASE WHEN new THEN 0 ELSE position+1 END,
         CASE WHEN new THEN size ELSE used+size END
  FROM (SELECT m.root, m.rn, m.path, m.size, m.doc_id, f.batch_no, f.position, f.used, f.position+1 >= 25 OR f.used + m.size > {BYTES} AS new
        FROM f JOIN m ON m.root=f.root AND m.rn=f.rn+1)) {tail}"""


_PLAN_TAIL = "SELECT root, path, size, batch_no, position FROM f"


def _plan(spark, sf_dir) -> DataFrame:
    return B.plan_batches(V.files(spark, sf_dir), max_bytes=BYTES)


@query("file_batches", "B1 O10", _plan_sql(_FILES, _PLAN_TAIL))
def file_batches(spark, sf_dir):
    return _plan(spark, sf_dir).drop("file_name")


@query("file_batches_of_one_root", "B1 O10", _plan_sql(_ONE_ROOT, _PLAN_TAIL))
def file_batches_of_one_root(spark, sf_dir):
    files = V.files(spark, sf_dir).withColumn("root", F.lit("/")).drop("file_name")
    return B.plan_batches(files, max_bytes=BYTES, block_rows=SEGMENT_FILES)


@query(
    "batch_strategies", "B2",
    _plan_sql(_FILES, """SELECT root, batch_no, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes,
      CASE WHEN count(*)=1 THEN 'SINGLE' ELSE 'BATCH' END AS strategy FROM f GROUP BY 1,2"""),
)
def batch_strategies(spark, sf_dir):
    return B.batch_table(_plan(spark, sf_dir))


def _outcomes(spark, sf_dir) -> DataFrame:
    """Upload results from the labels: good ones succeed, unlabelled files have none."""
    plan = _plan(spark, sf_dir).withColumn("doc_id", F.col("file_name").cast("bigint"))
    labels = V.table(spark, sf_dir, "labels").dropDuplicates(["doc_id"])
    results = plan.join(labels, "doc_id").select(
        "root", "batch_no", "position", (F.col("quality") == 1).alias("success"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("message"),
    )
    return B.item_outcomes(plan, results)


_OUT = """, x AS (SELECT f.*, coalesce(quality=1, false) AS success, CASE WHEN quality IS NULL THEN 'NO_RESULT' ELSE 'toxic '||toxic END AS message
  FROM f LEFT JOIN labels l ON l.doc_id=f.doc_id) """


@query("item_outcomes", "P26 J6", _plan_sql(_FILES, _OUT + "SELECT root, path, batch_no, position, success, message FROM x"))
def item_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("root", "path", "batch_no", "position", "success", "message")


@query(
    "upload_summary", "A10",
    _plan_sql(_FILES, _OUT + """SELECT root, count(*) AS total_count, count(*) FILTER (success) AS success_count,
      count(*) FILTER (NOT success) AS failure_count FROM x GROUP BY root"""),
)
def upload_summary(spark, sf_dir):
    return B.upload_summary(_outcomes(spark, sf_dir))


@query(
    "upload_progress", "A11",
    _plan_sql(_FILES, _OUT + """SELECT root, batch_no, processed, total_count, processed*100.0/total_count AS percent FROM (
      SELECT root, batch_no, CAST(sum(done) OVER (PARTITION BY root ORDER BY batch_no) AS BIGINT) AS processed,
             CAST(sum(items) OVER (PARTITION BY root) AS BIGINT) AS total_count
      FROM (SELECT root, batch_no, count(*) FILTER (success) AS done, count(*) AS items FROM x GROUP BY 1,2))"""),
)
def upload_progress(spark, sf_dir):
    return B.progress(_outcomes(spark, sf_dir))


@query(
    "upload_payloads", "P27 C21",
    """SELECT '/'||source||'/'||doc_id AS path, '{"Title":"'||doc_id||'","PathOnClient":"/'||source||'/'||doc_id||'","VersionData":"'||
         base64(encode(text))||'"}' AS payload FROM documents""",
)
def upload_payloads(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit(""), "source", F.col("doc_id").cast("string"))
    files = d.select(path.alias("path"), B.base_name(path).alias("file_name"), F.encode("text", "UTF-8").alias("content"))
    return B.upload_payloads(files)


TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)
_TABLE_ROWS = " UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name, count(*) AS n_rows FROM {t}" for t in TABLES)


@query("directory_scan", "S6 O10", f"SELECT file_name, n_rows, row_number() OVER (ORDER BY file_name) AS place FROM ({_TABLE_ROWS})")
def directory_scan(spark, sf_dir):
    """The table files in path order, with the rows that reading each of them gives."""
    files = B.scan_directory(spark, sf_dir).where(F.col("file_name").endswith(".parquet"))
    table = F.regexp_extract("path", r"([^/]+)\.parquet(/|$)", 1)
    # One name per table of the folder.
    tables = [r[0] for r in files.select(table).distinct().collect() if r[0] in TABLES]
    plain = lambda path: F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")
    listed = files.select(plain(F.col("path")).alias("path"), "file_name")
    if not tables:
        return listed.select("file_name", F.lit(0).cast("bigint").alias("n_rows"), F.lit(1).cast("bigint").alias("place")).limit(0)
    rows = None
    for t in sorted(tables):
        read = V.table(spark, sf_dir, t).groupBy(plain(F.col("_metadata.file_path")).alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
        rows = read if rows is None else rows.unionByName(read)
    found = listed.join(rows, "path", "left").orderBy("path")
    return in_order(found.select("file_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows")))


@query("target_row_count", "S8 A14", "SELECT count(*) AS n, 0 AS n_missing FROM lineitem")
def target_row_count(spark, sf_dir):
    """Rows of a table by name, and of one that does not exist."""
    V.table(spark, sf_dir, "lineitem").createOrReplaceTempView("counted_target")
    counts = (row_count(spark, "counted_target"), row_count(spark, "no_such_target"))
    return spark.createDataFrame([counts], "n bigint, n_missing bigint")
