"""Checked queries of the typed load, names, keys and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import coerce as C
from tidemark.functions import naming as M
from tidemark.functions.schema import effective_label
from tidemark.operators import catalog as O
from tidemark.plans import views as V
from tidemark.plans.checked import query

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


def _pick(col: Column, choices: list[Column | str]) -> Column:
    """One choice per line number, 1 to 7."""
    out = F.lit(None).cast("string")
    for i, c in enumerate(choices, 1):
        out = F.when(col == i, F.lit(c) if isinstance(c, str) else c).otherwise(out)
    return out


def _line_texts(spark, sf_dir, choices) -> DataFrame:
    li = V.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", _pick(F.col("l_linenumber"), choices(li)).alias("raw"))


def _money(c: Column) -> Column:
    return c.cast("decimal(14,2)").cast("string")


@query(
    "coerce_decimals", "C1",
    """SELECT l_orderkey, l_linenumber, l_suppkey,
         CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN l_extendedprice WHEN 5 THEN 1000.0 WHEN 6 THEN -0.5 END AS value,
         l_linenumber IN (3, 4, 7) AS invalid FROM lineitem""",
)
def coerce_decimals(spark, sf_dir):
    texts = _line_texts(spark, sf_dir, lambda li: [
        F.concat(F.lit("  "), F.col("l_quantity").cast("int").cast("string"), F.lit(" ")), _money(F.col("l_extendedprice")),
        "12,5", "", "1e3", "-.5", "NaN",
    ])
    return texts.select(
        "l_orderkey", "l_linenumber", "l_suppkey", C.coerce(F.col("raw"), "currency").alias("value"),
        C.invalid(F.col("raw"), "currency").alias("invalid"),
    )


@query(
    "coerce_integers", "C2",
    """SELECT l_orderkey, l_linenumber, l_suppkey,
         CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS INT) WHEN 2 THEN CAST(trunc(l_extendedprice) AS INT)
              WHEN 5 THEN -7 WHEN 6 THEN 7 END AS value,
         l_linenumber IN (3, 4, 7) AS invalid FROM lineitem""",
)
def coerce_integers(spark, sf_dir):
    texts = _line_texts(spark, sf_dir, lambda li: [
        F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string")), _money(F.col("l_extendedprice")),
        "99999999999", "x7", "-7", "+7", "",
    ])
    return texts.select(
        "l_orderkey", "l_linenumber", "l_suppkey", C.coerce(F.col("raw"), "int").alias("value"),
        C.invalid(F.col("raw"), "int").alias("invalid"),
    )


@query(
    "coerce_booleans", "C3",
    """SELECT l_orderkey, l_linenumber, l_suppkey,
         CASE l_linenumber WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false END AS value,
         l_linenumber >= 5 AS invalid FROM lineitem""",
)
def coerce_booleans(spark, sf_dir):
    texts = _line_texts(spark, sf_dir, lambda li: [" TRUE ", "False", "1", "0", "yes", "2", ""])
    return texts.select(
        "l_orderkey", "l_linenumber", "l_suppkey", C.coerce(F.col("raw"), "boolean").alias("value"),
        C.invalid(F.col("raw"), "boolean").alias("invalid"),
    )


#: A time of day for every order: as many seconds as its key, modulo a day.
_ORDER_US = "(epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000)"


def _order_times(spark, sf_dir) -> tuple[DataFrame, Column]:
    o = V.table(spark, sf_dir, "orders")
    us = V.micros("o_orderdate") + F.pmod("o_orderkey", F.lit(86400)) * 1_000_000
    return o.withColumn("us", us), F.timestamp_micros("us")


def _time_texts(spark, sf_dir) -> DataFrame:
    """A time text per order: the priority chooses the form, orders in progress are faulty."""
    o, ts = _order_times(spark, sf_dir)
    p = F.col("o_orderpriority")
    seoul = F.timestamp_micros(F.col("us") + F.lit(9 * 3_600_000_000))
    text = (
        F.when(p == "1-URGENT", F.floor(F.col("us") / 1000).cast("bigint").cast("string"))
        .when(p == "2-HIGH", F.floor(F.col("us") / 1_000_000).cast("bigint").cast("string"))
        .when(p == "3-MEDIUM", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.000+0000'"))
        .when(p == "4-NOT SPECIFIED", F.date_format(ts, " yyyy-MM-dd HH:mm:ss'.25'"))
        .otherwise(F.date_format(seoul, "yyyy-MM-dd'T'HH:mm:ss'+09:00'"))
    )
    wrong = F.when(F.col("o_orderpriority") < "3", "soon").otherwise("  ")
    return o.withColumn("raw", F.when(F.col("o_orderstatus") == "P", wrong).otherwise(text))


@query(
    "coerce_datetimes", "C4 C5",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN {_ORDER_US} +
          CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN 250000 ELSE 0 END END AS us,
          o_orderstatus='P' AND o_orderpriority < '3' AS invalid FROM orders""",
)
def coerce_datetimes(spark, sf_dir):
    t = _time_texts(spark, sf_dir)
    return t.select(
        "o_orderkey", F.unix_micros(C.coerce(F.col("raw"), "datetime")).alias("us"),
        C.invalid(F.col("raw"), "datetime").alias("invalid"),
    )


@query(
    "coerce_dates", "C6",
    """SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR)
         WHEN o_orderstatus='O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
         o_orderstatus='P' AND o_orderpriority < '3' AS invalid FROM orders""",
)
def coerce_dates(spark, sf_dir):
    t = _time_texts(spark, sf_dir)
    day = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd")
    raw = F.when(F.col("o_orderstatus") == "F", day).otherwise(F.col("raw"))
    t = t.withColumn("raw", raw)
    return t.select(
        "o_orderkey", F.date_format(C.coerce(F.col("raw"), "date"), "yyyy-MM-dd").alias("day"),
        C.invalid(F.col("raw"), "date").alias("invalid"),
    )


@query(
    "coerce_times", "C7 C8",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus='P' THEN NULL
          WHEN o_orderpriority='4-NOT SPECIFIED' THEN strftime(make_timestamp({_ORDER_US}), '%H:%M:%S')||'.250000'
          ELSE strftime(make_timestamp({_ORDER_US}), '%H:%M:%S') END AS clock,
          strftime(make_timestamp({_ORDER_US}), '%H:%M:%S') AS bare, strftime(make_timestamp({_ORDER_US}), '%Y-%m-%d %H:%M:%S.%f') AS stamp
        FROM orders""",
)
def coerce_times(spark, sf_dir):
    t = _time_texts(spark, sf_dir)
    bare = F.date_format(F.timestamp_micros(F.col("us") + F.lit(9 * 3_600_000_000)), "HH:mm:ss'+09:00'")
    stamp = C.datetime_text(F.timestamp_micros(F.col("us") + 5))
    return t.select(
        "o_orderkey", C.coerce(F.col("raw"), "time").alias("clock"), C.coerce(bare, "time").alias("bare"),
        F.regexp_replace(stamp, "000005$", "000000").alias("stamp"),
    )


@query(
    "json_scalars", "C9",
    """SELECT l_orderkey, l_linenumber, l_suppkey,
         CASE l_linenumber WHEN 1 THEN 'long' WHEN 2 THEN 'decimal' WHEN 3 THEN 'bool' WHEN 4 THEN 'text' WHEN 5 THEN 'null'
              WHEN 6 THEN 'text' ELSE 'bool' END AS kind,
         CASE l_linenumber WHEN 3 THEN true WHEN 7 THEN false END AS bool, CASE l_linenumber WHEN 1 THEN l_partkey END AS long,
         CASE l_linenumber WHEN 2 THEN l_extendedprice END AS decimal,
         CASE l_linenumber WHEN 4 THEN l_returnflag||' "x"' WHEN 6 THEN '7' END AS text FROM lineitem""",
)
def json_scalars(spark, sf_dir):
    texts = _line_texts(spark, sf_dir, lambda li: [
        F.col("l_partkey").cast("string"), _money(F.col("l_extendedprice")), "true",
        F.concat(F.lit('"'), F.col("l_returnflag"), F.lit(' \\"x\\""')), "null", '"7"', " false ",
    ])
    return texts.select("l_orderkey", "l_linenumber", "l_suppkey", C.json_scalar(F.col("raw")).alias("s")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "s.*"
    )


# -- keys and names ---------------------------------------------------------------------


def _addresses(spark, sf_dir) -> DataFrame:
    p = V.table(spark, sf_dir, "pages")
    k = F.pmod("page_id", F.lit(4))
    url = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("<"), F.col("url"), F.lit("|a page>")))
        .when(k == 2, F.concat(F.upper(F.regexp_extract("url", "^https?://([^/]+)", 1)), F.lit("/Path//")))
        .otherwise(F.concat(F.lit("  "), F.col("url"), F.lit("  ")))
    )
    return p.withColumn("address", url)


@query(
    "org_keys", "C10 F13",
    """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS org_key,
         contains(regexp_extract(url, '^https?://([^/]+)', 1), 'test') OR contains(regexp_extract(url, '^https?://([^/]+)', 1), 'sandbox') AS sandbox
       FROM pages""",
)
def org_keys(spark, sf_dir):
    a = _addresses(spark, sf_dir)
    return a.select("page_id", M.org_key(F.col("address")).alias("org_key"), O.is_sandbox(F.col("address")).alias("sandbox"))


@query(
    "route_keys", "C11",
    f"""SELECT selected_object AS object, routing_protocol AS protocol, org_key||'::'||routing_protocol||'::'||selected_object AS route_key
        FROM ({V.ROUTES_SQL})""",
)
def route_keys(spark, sf_dir):
    r = V.routes(spark, sf_dir)
    spaced = F.concat(F.lit(" "), F.col("selected_object"), F.lit(" "))
    key = M.route_key(F.col("my_domain"), spaced, F.lower("routing_protocol"))
    return r.select(F.col("selected_object").alias("object"), F.col("routing_protocol").alias("protocol"), key.alias("route_key"))


@query(
    "masked_values", "C12",
    """SELECT p_partkey, field, CASE WHEN v IS NULL OR trim(v)='' THEN NULL WHEN length(v)<=2 THEN repeat('*', length(v))
         WHEN length(v)<=4 THEN v[1]||'***' ELSE v[1:2]||'******'||right(v,2) END AS masked
       FROM (SELECT p_partkey, unnest(['name', 'key', 'size', 'blank']) AS field,
               unnest([CASE WHEN p_size % 8 > 0 THEN p_name END, CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR), ' ']) AS v FROM part)""",
)
def masked_values(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    values = {
        "name": F.when(F.col("p_size") % 8 > 0, F.col("p_name")), "key": F.col("p_partkey").cast("string"),
        "size": F.col("p_size").cast("string"), "blank": F.lit(" "),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("v")) for n, v in values.items()])
    rows = p.select("p_partkey", F.inline(pairs))
    return rows.select("p_partkey", "field", M.mask(F.col("v")).alias("masked"))


@query(
    "masked_properties", "C13",
    """SELECT c_custkey, 'accessToken=****,dbPassword=****,empty=null,user='||c_name AS shown FROM customer""",
)
def masked_properties(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    entries = F.create_map(
        F.lit("dbPassword"), F.col("c_mktsegment"), F.lit("user"), F.col("c_name"),
        F.lit("accessToken"), F.col("c_custkey").cast("string"), F.lit("empty"), F.lit(None).cast("string"),
    )
    shown = F.array_sort(F.transform(F.map_entries(M.mask_properties(entries)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return c.select("c_custkey", F.array_join(shown, ",").alias("shown"))





@query(
    "prefixed_table_names", "C14",
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'org_' || p_brand WHEN 2 THEN p_partkey || ' Co.'
                  ELSE p_name || ' -- ' || p_type END AS org,
                 CASE p_partkey % 7 WHEN 0 THEN 'org_x_' || p_partkey WHEN 1 THEN NULL ELSE p_type || '__c' END AS obj FROM part),
     u AS (SELECT *, regexp_replace(regexp_replace(upper(trim(coalesce(org,''))), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS a,
                     regexp_replace(regexp_replace(upper(trim(coalesce(obj,''))), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS b FROM n),
     v AS (SELECT *, CASE WHEN a='' THEN 'ORG' WHEN a[1] BETWEEN '0' AND '9' THEN 'ORG_'||a ELSE a END AS a1,
                     CASE WHEN b='' THEN 'OBJECT' WHEN b[1] BETWEEN '0' AND '9' THEN 'ORG_'||b ELSE b END AS b1 FROM u),
     w AS (SELECT *, 'ORG_'||regexp_replace(a1,'^(ORG_)+','')||'_'||regexp_replace(b1,'^(ORG_)+','') AS f FROM v)
     SELECT p_partkey, CASE WHEN regexp_full_match(upper(trim(obj)), 'ORG_[A-Z0-9_]+_[A-Z0-9_]+') THEN upper(trim(obj))
       WHEN length(f) <= 30 THEN f ELSE regexp_replace(f[1:21], '_+$', '')||'_'||upper(sha1(f)[1:8]) END AS table_name FROM w""",
)
def prefixed_table_names(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    k, j = F.pmod("p_partkey", F.lit(5)), F.pmod("p_partkey", F.lit(7))
    org = (
        F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("org_"), "p_brand")).when(k == 2, F.concat(key, F.lit(" Co.")))
        .otherwise(F.concat_ws(" -- ", "p_name", "p_type"))
    )
    obj = F.when(j == 0, F.concat(F.lit("org_x_"), key)).when(j == 1, None).otherwise(F.concat("p_type", F.lit("__c")))
    return p.select("p_partkey", M.prefixed_table_name(org, obj).alias("table_name"))


@query(
    "org_schema_names", "C15",
    r"""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '  My   org ' || page_id WHEN 2 THEN page_id || '!'
                   ELSE '  ' END AS raw FROM pages),
     u AS (SELECT page_id, CASE WHEN trim(raw)='' THEN 'default_org' ELSE raw END AS raw FROM n),
     p AS (SELECT page_id, raw, regexp_replace(trim(raw), '\s+', ' ', 'g') AS plain FROM u),
     c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '[^A-Za-z0-9_ ]', '_', 'g'),
               '\s+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS v FROM p),
     d AS (SELECT *, CASE WHEN v='' THEN 'org_default' WHEN v[1] BETWEEN '0' AND '9' THEN ('org_'||v)[1:48]
               WHEN length(v)=1 THEN v||'_org' ELSE v[1:48] END AS co FROM c),
     e AS (SELECT page_id, regexp_replace(regexp_replace(replace(lower(CASE WHEN regexp_full_match(plain, '[A-Za-z][A-Za-z0-9_ ]{1,47}')
               THEN plain ELSE co END), ' ', '_'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM d)
     SELECT page_id, 'org_'||s[1:48] AS schema_name FROM e""",
)
def org_schema_names(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    k, key = F.pmod("page_id", F.lit(4)), F.col("page_id").cast("string")
    raw = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("  My   org "), key)).when(k == 2, F.concat(key, F.lit("!")))
        .otherwise("  ")
    )
    return p.select("page_id", M.org_schema_name(raw).alias("schema_name"))


@query(
    "first_non_blank_names", "C22",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_name ELSE '-' END AS shown FROM part""",
)
def first_non_blank_names(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    k = F.col("p_size") % 3
    first = F.when(k == 0, F.col("p_brand")).when(k == 1, "  ")
    return p.select("p_partkey", M.first_non_blank(first, F.when(k == 1, F.col("p_name"))).alias("shown"))


@query(
    "effective_labels", "C18",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_type ELSE p_name END AS label FROM part""",
)
def effective_labels(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    k = F.col("p_size") % 4
    label = F.when(k == 0, F.col("p_type")).when(k == 1, " ").when(k == 2, F.concat(F.lit("__MISSING LABEL__ "), "p_type"))
    return p.select("p_partkey", effective_label(label, F.col("p_name")).alias("label"))


@query(
    "identifier_checks", "F6 F7 F10",
    """SELECT page_id, regexp_full_match(host, '[A-Za-z_][A-Za-z0-9_]*') AS identifier,
         regexp_full_match(lpad(CAST(page_id AS VARCHAR), CAST(17 + page_id % 3 AS INT), 'a'), '[A-Za-z0-9]{18}') AS record_key,
         regexp_full_match(url, '[A-Za-z0-9._:-]{1,120}') OR regexp_full_match(host, '[A-Za-z0-9._:-]{1,120}') AS simple_key
       FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/.]+)', 1) AS host FROM pages)""",
)
def identifier_checks(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/.]+)", 1)
    key = F.lpad(F.col("page_id").cast("string"), 20, "a")
    key = F.right(key, (F.lit(17) + F.pmod("page_id", F.lit(3))).cast("int"))
    return p.select(
        "page_id", O.valid_identifier(host).alias("identifier"), O.valid_record_key(key).alias("record_key"),
        (O.valid_simple_key(F.col("url")) | O.valid_simple_key(host)).alias("simple_key"),
    )
