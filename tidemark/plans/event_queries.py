"""Checked queries of event normalisation and of the feeds and describe scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.columns import KEY, LAST_EVENT, LAST_MODIFIED
from tidemark.functions.schema import schema_table
from tidemark.operators import fold as K
from tidemark.operators import normalize as N
from tidemark.operators.catalog import fiscal_fields, value_lengths
from tidemark.operators.snapshot import snapshot_rows
from tidemark.plans import views as V
from tidemark.plans.checked import query
from tidemark.plans.mutation_queries import ROWS_TAIL, fold_sql
from tidemark.session import cut_lineage, shared_folder
from tidemark.sources import describe as D
from tidemark.sources.feeds import file_feed
from tidemark.sources.store import KeyedTable
from tidemark.streaming.apply import start_route


def _listed(names: str) -> Column:
    return F.array_join(F.array_sort(names), ",")


def _changes(spark, sf_dir) -> DataFrame:
    out = N.normalize_changes(V.change_feed(spark, sf_dir), V.CHANGE_FIELDS, V.now())
    return N.typed(out, V.CHANGE_FIELDS)


#: The change feed's mutations, straight from the events.
_CHANGES = f"""
SELECT lpad(CAST(user_id AS VARCHAR), 18, '0') AS k, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'view' THEN 'UNDELETE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS t,
  CASE WHEN event_type='error' THEN {V.NOW_US} ELSE epoch_us(ts)//1000*1000 END AS ev,
  CASE WHEN event_type<>'error' THEN (epoch_us(ts)//1000000 - event_id%7*86400)*1000000 END AS lm,
  CASE WHEN event_type<>'error' THEN value END AS value,
  CASE WHEN event_type IN ('signup','view') THEN props END AS props,
  event_type <> 'click' AS both_set, event_type <> 'error' AS some_set, event_type
FROM events WHERE value >= 3
"""


@query(
    "change_feed_mutations", "P1 P5 P7 P8 P11 P14 P17 P18 P19 P20 S4 U2 U3 C1 C5",
    f"""SELECT seq, k AS sfid, t AS change_type, lm AS lm_us, ev AS ev_us, value AS amount, props AS note,
          CASE event_type WHEN 'click' THEN 'Amount' WHEN 'purchase' THEN 'Amount,Note' WHEN 'error' THEN ''
               ELSE 'Amount,LastModifiedDate,Note' END AS targets FROM ({_CHANGES})""",
)
def change_feed_mutations(spark, sf_dir):
    return N.accepted(_changes(spark, sf_dir)).select(
        "seq", "sfid", "change_type", F.unix_micros("lm").alias("lm_us"), F.unix_micros("ev").alias("ev_us"),
        F.col("vals.Amount").alias("amount"), F.col("vals.Note").alias("note"), _listed("target_fields").alias("targets"),
    )


@query(
    "change_feed_rejects", "P2 P3 P5 T8 T10",
    """SELECT event_id AS seq, CASE WHEN value<1 THEN 'no_header' WHEN value<2 THEN 'change_type' ELSE 'no_key' END AS reject_reason
       FROM events WHERE value < 3""",
)
def change_feed_rejects(spark, sf_dir):
    return N.rejected(_changes(spark, sf_dir)).select("seq", "reject_reason")


@query("change_feed_applied", "P1 P20 K3 K5 K9 T2 T3", fold_sql(_CHANGES, tail=ROWS_TAIL))
def change_feed_applied(spark, sf_dir):
    # The fold reads its mutations twice: they are normalised once, and written.
    rows = K.apply_mutations(cut_lineage(N.accepted(_changes(spark, sf_dir))))
    return rows.select(
        "sfid", F.col("Amount").alias("value"), F.col("Note").alias("props"),
        V.micros("_oc_last_modified_at").alias("lm_us"), V.micros("_oc_last_event_at").alias("ev_us"),
    )


def table_schema(mutations: DataFrame) -> T.StructType:
    """Columns of a target that typed mutations are applied to."""
    times = [T.StructField(c, T.TimestampType()) for c in (LAST_MODIFIED, LAST_EVENT)]
    return T.StructType([mutations.schema[KEY], *mutations.schema["vals"].dataType.fields, *times])


@query("change_feed_streamed", "S4 S9 T1 T2 T6 T10", fold_sql(_CHANGES, tail=ROWS_TAIL))
def change_feed_streamed(spark, sf_dir):
    """The feed as files, applied to a table by a streaming route that is restarted half way."""
    feed, checkpoint, path = (shared_folder(spark, kind) for kind in ("feeds", "routes", "tables"))
    events = V.change_feed(spark, sf_dir)
    half = events.agg(F.floor(F.max("seq") / 2)).scalar()
    for part in (F.col("seq") <= half, F.col("seq") > half):
        events.where(part).write.mode("append").parquet(feed)
        out = N.normalize_changes(file_feed(spark, feed, fmt="parquet"), V.CHANGE_FIELDS, V.now())
        mutations = N.typed(out, V.CHANGE_FIELDS)
        table = KeyedTable(spark, path, table_schema(mutations), buckets=8)
        start_route(mutations, table, checkpoint, available_now=True, name="route").awaitTermination()
    return table.read().select(
        KEY, F.col("Amount").alias("value"), F.col("Note").alias("props"),
        V.micros(LAST_MODIFIED).alias("lm_us"), V.micros(LAST_EVENT).alias("ev_us"),
    )


_CONTACTS = "FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey"


@query(
    "compound_names", "P9 P14 P15",
    f"""SELECT c_custkey AS seq,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'FirstName,Name' WHEN 'FURNITURE' THEN 'Name' WHEN 'HOUSEHOLD' THEN 'Name'
               ELSE 'FirstName,LastName,Name' END AS name_targets,
          CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'FURNITURE' THEN 'Dr '||c_name WHEN 'HOUSEHOLD' THEN n_name
               ELSE c_mktsegment||' '||n_name||' '||c_name END AS name,
          CASE WHEN c_mktsegment IN ('BUILDING','AUTOMOBILE','MACHINERY') THEN c_name END AS first_name,
          CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN n_name END AS last_name {_CONTACTS}""",
)
def compound_names(spark, sf_dir):
    out = N.normalize_changes(V.contact_feed(spark, sf_dir), V.CONTACT_FIELDS, V.now())
    names = F.filter("target_fields", lambda t: t.isin("Name", "FirstName", "LastName"))
    return out.select(
        "seq", F.array_join(F.array_sort(names), ",").alias("name_targets"), F.col("vals.Name").alias("name"),
        F.col("vals.FirstName").alias("first_name"), F.col("vals.LastName").alias("last_name"),
    )


@query(
    "compound_addresses", "P10 P14 P16 P18",
    f"""SELECT c_custkey AS seq,
          CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY')
               THEN 'MailingAddress,MailingCity,MailingCountry,MailingPostalCode,MailingState,MailingStreet'
               WHEN c_mktsegment='FURNITURE' THEN 'MailingAddress,MailingCity,MailingCountry' ELSE '' END AS address_targets,
          CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN r_name||' '||n_name||' '||c_mktsegment||' '||c_name||' '||c_custkey
               WHEN c_mktsegment='FURNITURE' THEN r_name END AS address,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_mktsegment WHEN 'FURNITURE' THEN '  ' END AS city,
          CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN c_name END AS street,
          CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY','FURNITURE') THEN r_name END AS country {_CONTACTS}""",
)
def compound_addresses(spark, sf_dir):
    out = N.normalize_changes(V.contact_feed(spark, sf_dir), V.CONTACT_FIELDS, V.now())
    names = F.filter("target_fields", lambda t: t.startswith("Mailing"))
    return out.select(
        "seq", F.array_join(F.array_sort(names), ",").alias("address_targets"), F.col("vals.MailingAddress").alias("address"),
        F.col("vals.MailingCity").alias("city"), F.col("vals.MailingStreet").alias("street"),
        F.col("vals.MailingCountry").alias("country"),
    )


def _order_values() -> list[Column]:
    return [
        F.col("vals.Fiscal").alias("fiscal"), F.col("vals.FiscalYear").alias("fiscal_year"),
        F.col("vals.FiscalQuarter").alias("fiscal_quarter"), F.col("vals.Amount").alias("amount"),
    ]


@query(
    "fiscal_periods", "P13 C2",
    """SELECT o_orderkey AS seq,
         CASE WHEN o_orderpriority <> '5-LOW' THEN
                CASE WHEN o_orderstatus='F' THEN 'Fiscal,FiscalQuarter,FiscalYear,Stage' ELSE 'Amount,Fiscal,FiscalQuarter,FiscalYear' END
              WHEN o_orderstatus='F' THEN 'Stage' ELSE 'Amount' END AS targets,
         CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate)||' '||quarter(o_orderdate) END AS fiscal,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) AS INT) END AS fiscal_year,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(quarter(o_orderdate) AS INT) END AS fiscal_quarter,
         CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS amount FROM orders""",
)
def fiscal_periods(spark, sf_dir):
    out = N.normalize_changes(V.order_changes(spark, sf_dir), V.ORDER_FIELDS, V.now())
    return N.typed(out, V.ORDER_FIELDS).select("seq", _listed("target_fields").alias("targets"), *_order_values())


_KIND = """CASE WHEN o_orderpriority='1-URGENT' THEN NULL WHEN o_orderstatus='F' THEN 'CREATE'
  WHEN o_orderstatus='O' THEN 'UPDATE' ELSE 'DELETE' END"""
_KEYLESS = "(o_orderpriority='2-HIGH' AND o_orderstatus='F')"


_NOTICES = f"""SELECT o_orderkey AS seq, 'k'||o_custkey AS sfid, t AS change_type,
         CASE WHEN t <> 'DELETE' THEN epoch_us(o_orderdate) END AS lm_us,
         CASE WHEN t = 'DELETE' THEN {V.NOW_US} ELSE epoch_us(o_orderdate) END AS ev_us,
         CASE WHEN t='DELETE' THEN '' WHEN o_orderpriority='5-LOW' THEN 'Amount,LastModifiedDate'
              ELSE 'Amount,Fiscal,FiscalQuarter,FiscalYear,LastModifiedDate' END AS targets,
         CASE WHEN t <> 'DELETE' AND o_orderpriority <> '5-LOW' THEN year(o_orderdate)||' '||quarter(o_orderdate) END AS fiscal,
         CASE WHEN t <> 'DELETE' AND o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) AS INT) END AS fiscal_year,
         CASE WHEN t <> 'DELETE' AND o_orderpriority <> '5-LOW' THEN CAST(quarter(o_orderdate) AS INT) END AS fiscal_quarter,
         CASE WHEN t <> 'DELETE' AND o_orderpriority <> '3-MEDIUM' THEN o_totalprice END AS amount
       FROM (SELECT *, {_KIND} AS t FROM orders) WHERE t IS NOT NULL AND NOT {_KEYLESS}"""


def _notice_rows(out: DataFrame) -> DataFrame:
    return out.select(
        "seq", "sfid", "change_type", F.unix_micros("lm").alias("lm_us"), F.unix_micros("ev").alias("ev_us"),
        _listed("target_fields").alias("targets"), *_order_values(),
    )


@query("notice_mutations", "P4 P6 P12 P13 P19 P20", _NOTICES)
def notice_mutations(spark, sf_dir):
    out = N.typed(N.normalize_notices(V.notice_feed(spark, sf_dir), V.ORDER_FIELDS, V.now()), V.ORDER_FIELDS)
    return _notice_rows(N.accepted(out))


@query("notices_streamed", "S5 T1", _NOTICES)
def notices_streamed(spark, sf_dir):
    """The same notifications as files of a stream, normalised into a table until nothing is left."""
    feed, checkpoint, path = (shared_folder(spark, kind) for kind in ("feeds", "routes", "mutations"))
    V.notice_feed(spark, sf_dir).write.parquet(feed)
    read = file_feed(spark, feed, notices=True, fmt="parquet")
    out = N.accepted(N.typed(N.normalize_notices(read, V.ORDER_FIELDS, V.now()), V.ORDER_FIELDS))
    sink = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    sink.trigger(availableNow=True).start().awaitTermination()
    return _notice_rows(spark.read.schema(out.schema).parquet(path))


@query(
    "notice_rejects", "P4 P6 T8",
    f"""SELECT o_orderkey AS seq, CASE WHEN o_orderpriority='1-URGENT' THEN 'change_type' ELSE 'no_key' END AS reject_reason
        FROM orders WHERE o_orderpriority='1-URGENT' OR {_KEYLESS}""",
)
def notice_rejects(spark, sf_dir):
    out = N.normalize_notices(V.notice_feed(spark, sf_dir), V.ORDER_FIELDS, V.now())
    return N.rejected(out).select("seq", "reject_reason")


@query(
    "value_length_profile", "P28",
    """SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY length DESC, field) - 1 AS place, field, length FROM (
         SELECT event_id AS seq, unnest(['Note', 'Stage', 'Gone']) AS field,
           unnest([coalesce(length(props), 0), coalesce(length(event_type), 0), 0]) AS length FROM events)""",
)
def value_length_profile(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    entries = F.create_map(F.lit("Note"), F.col("props"), F.lit("Stage"), F.col("event_type"), F.lit("Gone"), F.lit(None).cast("string"))
    rows = e.select(F.col("event_id").alias("seq"), F.posexplode(value_lengths(entries)).alias("place", "pair"))
    return rows.select("seq", F.col("place").cast("bigint").alias("place"), "pair.field", F.col("pair.length").cast("bigint").alias("length"))


@query(
    "fiscal_field_profile", "F14",
    """SELECT o_orderkey AS seq, 'FY'||year(o_orderdate)||'_Quarter='||o_orderstatus||',fiscalNote='||o_orderpriority AS kept FROM orders""",
)
def fiscal_field_profile(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    year = F.concat(F.lit("FY"), F.year("o_orderdate").cast("string"), F.lit("_Quarter"))
    entries = F.create_map(
        year, F.col("o_orderstatus"), F.lit("Amount"), F.lit("1"), F.lit("fiscalNote"), F.col("o_orderpriority")
    )
    kept = F.transform(F.map_entries(fiscal_fields(entries)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return o.select(F.col("o_orderkey").alias("seq"), F.array_join(kept, ",").alias("kept"))


# -- describe, catalogue and snapshot scans ---------------------------------------------

_TYPE_NAMES = (
    "id", "reference", "textarea", "string", "picklist", "multipicklist", "phone", "url", "boolean",
    "datetime", "date", "time", "double", "percent", "currency", "int", "location",
)


def describe_docs(spark, sf_dir) -> DataFrame:
    """One describe document per part, with two fields."""
    p = V.table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(t) for t in _TYPE_NAMES])

    def field(suffix, shift):
        n = F.pmod(F.col("p_partkey") + shift, F.lit(len(_TYPE_NAMES))).cast("int")
        return F.struct(
            F.concat(F.lit(f"F{suffix}_"), F.col("p_partkey").cast("string")).alias("name"),
            kinds[n].alias("type"),
            F.concat(F.col("p_type"), F.lit("'s "), F.col("p_name")).alias("label"),
            (F.col("p_size") * 200 * shift).cast("int").alias("length"),
        )

    doc = F.to_json(F.struct(F.array(field("a", 0), field("b", 1)).alias("fields")))
    return p.select(F.col("p_partkey").alias("object_id"), doc.alias("body"))


_NAMES_SQL = "[" + ",".join(f"'{t}'" for t in _TYPE_NAMES) + "]"
_FIELDS = f"""
SELECT p_partkey AS object_id, 'F'||s.suffix||'_'||p_partkey AS name,
       {_NAMES_SQL}[CAST((p_partkey + s.shift) % {len(_TYPE_NAMES)} + 1 AS INT)] AS type, p_type||'''s '||p_name AS label,
       CAST(p_size*200*s.shift AS INT) AS length FROM part, (VALUES ('a',0),('b',1)) s(suffix, shift)
"""


@query("describe_scan", "S1", _FIELDS)
def describe_scan(spark, sf_dir):
    return D.fields_from_text(describe_docs(spark, sf_dir)).select("object_id", "name", "type", "label", "length")


def _type_sql(key, text, long, boolean, stamp, clock, double, integer, other, shortest, mysql) -> str:
    sized = f"'{text}('||greatest(length,{shortest})||')'"
    area = f"CASE WHEN length>4000 THEN 'TEXT' ELSE 'VARCHAR('||length||')' END" if mysql else f"'{long}'"
    return f"""CASE WHEN type IN ('id','reference') THEN '{key}' WHEN type='textarea' THEN {area}
      WHEN type IN ('string','picklist','multipicklist','phone','url') THEN {sized} WHEN type='boolean' THEN '{boolean}'
      WHEN type='datetime' THEN '{stamp}' WHEN type='date' THEN 'DATE' WHEN type='time' THEN '{clock}'
      WHEN type IN ('double','percent','currency') THEN '{double}' WHEN type='int' THEN '{integer}' ELSE '{other}' END"""


_DIALECT_SQL = {
    "MYSQL": _type_sql("VARCHAR(18)", "VARCHAR", "", "BOOLEAN", "DATETIME(6)", "TIME(6)", "DOUBLE", "INT", "VARCHAR(255)", 1, True),
    "POSTGRESQL": _type_sql("VARCHAR(18)", "VARCHAR", "TEXT", "BOOLEAN", "TIMESTAMP(6)", "TIME(6)", "DOUBLE PRECISION", "INTEGER", "VARCHAR(255)", 255, False),
    "ORACLE": _type_sql("VARCHAR2(18)", "VARCHAR2", "CLOB", "NUMBER(1)", "TIMESTAMP(6)", "VARCHAR2(18)", "BINARY_DOUBLE", "NUMBER(10)", "VARCHAR2(255)", 255, False),
}


def _schema_query(dialect: str, name: str) -> None:
    sql = f"""SELECT CASE WHEN type='id' THEN 'sfid' ELSE name END AS column_name, {_DIALECT_SQL[dialect]} AS column_type,
                replace(label, '''', '`') AS comment FROM ({_FIELDS})
              UNION ALL SELECT c, '{'DATETIME(6)' if dialect == 'MYSQL' else 'TIMESTAMP(6)'}', NULL
              FROM (VALUES ('_oc_last_modified_at'),('_oc_last_event_at')) t(c)"""

    @query(name, "P22 C19 C20", sql)
    def run(spark, sf_dir):
        return schema_table(D.fields_from_text(describe_docs(spark, sf_dir)), dialect)


for _dialect, _name in (("MYSQL", "schema_mysql"), ("POSTGRESQL", "schema_postgresql"), ("ORACLE", "schema_oracle")):
    _schema_query(_dialect, _name)


@query("notice_fields", "P23", f"SELECT object_id, name FROM ({_FIELDS}) WHERE type <> 'textarea'")
def notice_fields(spark, sf_dir):
    return D.notice_fields(D.fields_from_text(describe_docs(spark, sf_dir))).select("object_id", "name")


@query(
    "change_entities", "P24",
    """SELECT name, CASE WHEN name LIKE '%ChangeEvent' THEN name WHEN right(name,3)='__c' THEN left(name, length(name)-3)||'__ChangeEvent'
              ELSE name||'ChangeEvent' END AS entity,
            CASE WHEN right(name,13)='__ChangeEvent' THEN left(name, length(name)-13)||'__c'
                 WHEN right(name,11)='ChangeEvent' THEN left(name, length(name)-11) ELSE name END AS object
       FROM (SELECT replace(p_name,' ','_')||p_partkey||CASE p_partkey%4 WHEN 0 THEN '__c' WHEN 1 THEN '__ChangeEvent'
               WHEN 2 THEN 'ChangeEvent' ELSE '' END AS name FROM part)""",
)
def change_entities(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    k = F.pmod("p_partkey", F.lit(4))
    tail = F.when(k == 0, "__c").when(k == 1, "__ChangeEvent").when(k == 2, "ChangeEvent").otherwise("")
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.col("p_partkey").cast("string"), tail)
    rows = p.select(name.alias("name"))
    return rows.select("name", D.change_entity(F.col("name")).alias("entity"), D.entity_of_change(F.col("name")).alias("object"))


@query(
    "catalogue_scan", "S3 F8",
    """SELECT 'd'||p_partkey AS durable_id, p_name||'_'||p_partkey AS name, p_type AS label FROM part WHERE p_size % 5 <> 0
       UNION ALL SELECT 'X'||p_partkey, 'X'||p_partkey, 'X'||p_partkey FROM part""",
)
def catalogue_scan(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    none = F.lit(None).cast("string")
    named = F.struct(
        F.concat_ws("_", "p_name", key).alias("QualifiedApiName"), F.col("p_type").alias("Label"),
        F.concat(F.lit("d"), key).alias("DurableId"), (F.col("p_size") % 5 != 0).alias("IsQueryable"),
    )
    bare = F.struct(
        F.concat(F.lit("X"), key).alias("QualifiedApiName"), none.alias("Label"), none.alias("DurableId"),
        F.lit(True).alias("IsQueryable"),
    )
    blank = F.struct(F.lit(" ").alias("QualifiedApiName"), none.alias("Label"), none.alias("DurableId"), F.lit(True).alias("IsQueryable"))
    pages = p.select(F.to_json(F.struct(F.array(named, bare, blank).alias("records"))).alias("body"))
    return D.catalogue_rows(pages.select(F.from_json("body", D.CATALOGUE_SCHEMA).alias("p")).select("p.*"))


@query(
    "snapshot_scan", "S2 P21 K1",
    """SELECT CAST(o_orderkey AS VARCHAR) AS sfid, o_totalprice AS amount, o_orderstatus AS stage,
              epoch_us(o_orderdate) AS lm_us, epoch_us(o_orderdate) AS ev_us FROM orders
       UNION ALL SELECT 'x'||o_orderkey, NULL, NULL, NULL, NULL FROM orders""",
)
def snapshot_scan(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    ms = F.floor(V.micros("o_orderdate") / 1000).cast("bigint")
    full = F.to_json(F.struct(
        key.alias("Id"), F.col("o_totalprice").alias("Amount"), F.col("o_orderstatus").alias("Stage"), ms.alias("LastModifiedDate"),
    ))
    page = F.concat(F.lit('{"records":['), full, F.lit(',{"Id":"x'), key, F.lit('"}]}'))
    types = {"Amount": "currency", "Stage": "string"}
    records = D.record_texts(o.select(page.alias("body")))
    rows = snapshot_rows(N.accepted(N.typed(N.normalize_snapshot(records, types), types)))
    return rows.select(
        "sfid", F.col("Amount").alias("amount"), F.col("Stage").alias("stage"),
        V.micros("_oc_last_modified_at").alias("lm_us"), V.micros("_oc_last_event_at").alias("ev_us"),
    )
