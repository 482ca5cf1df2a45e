"""Checked queries of the object catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import catalog as O
from tidemark.operators.order_index import index_order
from tidemark.plans import views as V
from tidemark.plans.checked import query

_O = f"WITH o AS ({V.OBJECTS_SQL}), s AS ({V.STATUSES_SQL}), j AS (SELECT o.id, o.name, o.label, coalesce(s.status,'NONE') AS status FROM o LEFT JOIN s ON s.selected_object=o.name)"


def _listing(spark, sf_dir):
    return O.with_status(V.objects(spark, sf_dir), V.object_statuses(spark, sf_dir)).select("id", "name", "label", "status")


@query(
    "catalogue_search", "F4",
    f"{_O} SELECT id, name, label FROM o WHERE contains(lower(coalesce(label,'')), 'brand#1') OR contains(lower(name), 'blue')"
    " INTERSECT SELECT id, name, label FROM o WHERE contains(lower(coalesce(label,'')), 'promo') OR contains(lower(name), 'promo')",
)
def catalogue_search(spark, sf_dir):
    o = V.objects(spark, sf_dir)
    either = O.search(o, "BRAND#1").unionByName(O.search(o, " Blue ")).distinct()
    return O.search(either, "Promo")


@query("catalogue_with_status", "J2 F5", f"{_O} SELECT * FROM j")
def catalogue_with_status(spark, sf_dir):
    return O.filter_status(_listing(spark, sf_dir), "whatever")


def _status_query(status: str) -> None:
    @query(f"catalogue_status_{status.lower()}", "F5 J2", f"{_O} SELECT * FROM j WHERE status='{status}'")
    def run(spark, sf_dir):
        return O.filter_status(_listing(spark, sf_dir), status.lower())


for _s in ("NONE", "STREAMING", "CDC"):
    _status_query(_s)

_LABEL, _API = "lower(coalesce(label,''))", "lower(name)"
_LIST_ORDERS = {
    "LABEL_ASC": f"{_LABEL}, {_API}",
    "LABEL_DESC": f"{_LABEL} DESC, {_API}",
    "API_ASC": f"{_API}, {_LABEL}",
    "API_DESC": f"{_API} DESC, {_LABEL}",
    "STATUS_ASC": f"lower(status), {_LABEL}",
    "STATUS_DESC": f"lower(status) DESC, {_LABEL} DESC",
}
_SERVICE_ORDERS = {
    "LABEL_ASC": f"{_LABEL}, {_API}",
    "LABEL_DESC": f"{_LABEL} DESC, {_API} DESC",
    "API_DESC": f"{_API} DESC",
    "API_ASC": _API,
}


def _list_query(sort: str, order: str) -> None:
    @query(f"catalogue_page_{sort.lower()}", "O2 O7", f"{_O} SELECT * FROM j ORDER BY {order}, name LIMIT 50 OFFSET 100")
    def run(spark, sf_dir):
        return O.filtered_page(_listing(spark, sf_dir), "ALL", sort, page=3, size=50)


def _service_query(sort: str, order: str) -> None:
    @query(
        f"search_page_{sort.lower()}", "O3 O4 F4",
        f"{_O} SELECT id, name, label FROM o WHERE contains(lower(coalesce(label,'')), 'st') OR contains(lower(name), 'st')"
        f" ORDER BY {order}, name LIMIT 200 OFFSET 200",
    )
    def run(spark, sf_dir):
        return O.search_page(V.objects(spark, sf_dir), "ST", sort, page=2, size=500)[0]


for _sort, _order in _LIST_ORDERS.items():
    _list_query(_sort, _order)
for _sort, _order in _SERVICE_ORDERS.items():
    _service_query(_sort, _order)


@query(
    "catalogue_status_page", "O7",
    f"{_O} SELECT * FROM j WHERE status='STREAMING' ORDER BY {_LIST_ORDERS['LABEL_DESC']}, name LIMIT 20 OFFSET 20",
)
def catalogue_status_page(spark, sf_dir):
    return O.filtered_page(_listing(spark, sf_dir), "streaming", "label_desc", page=2, size=20)


@query(
    "search_total", "O4",
    f"{_O} SELECT count(*) AS total FROM o WHERE contains(lower(coalesce(label,'')), 'st') OR contains(lower(name), 'st')",
)
def search_total(spark, sf_dir):
    return O.search_page(V.objects(spark, sf_dir), "st", None, 1, 10)[1]


#: Rows of a range that are few enough for the given tables to have several.
RANGE_ROWS = 100


def _deep(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The page in the middle of a listing, and where it stands."""
    index = index_order(rows, order, range_rows=RANGE_ROWS)
    page = index.total().first().total // 2 // size + 1
    return index.page(page, size).withColumn("page", F.lit(page).cast("bigint"))


def _deep_sql(rows: str, order: str, size: int) -> str:
    return f"""WITH d AS ({rows}), n AS (SELECT count(*) // 2 // {size} AS p FROM d)
      SELECT * EXCLUDE (place, p), p + 1 AS page FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS place FROM d), n WHERE place // {size} = p"""


@query("deep_search_page", "O4 O3", _deep_sql(f"SELECT id, name, label FROM ({V.OBJECTS_SQL}) o WHERE contains(lower(coalesce(label,'')), 'st') OR contains(lower(name), 'st')", f"{_SERVICE_ORDERS['LABEL_DESC']}, name", 20))
def deep_search_page(spark, sf_dir):
    return _deep(O.search(V.objects(spark, sf_dir), "st"), O.service_order("LABEL_DESC"), 20)


@query("deep_status_page", "O7 O2", _deep_sql(f"{_O} SELECT * FROM j WHERE status='STREAMING'", f"{_LIST_ORDERS['LABEL_ASC']}, name", 10))
def deep_status_page(spark, sf_dir):
    return _deep(O.filter_status(_listing(spark, sf_dir), "STREAMING"), O.list_order("LABEL_ASC"), 10)


@query("deep_page_of_items", "O4", _deep_sql("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem", "l_shipdate DESC, l_orderkey, l_linenumber", 50))
def deep_page_of_items(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return _deep(rows, [F.col("l_shipdate").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()], 50)


def _page_info_sql(size: int, page: int) -> str:
    return f"""SELECT total, pages, page, CASE WHEN total=0 THEN 0 ELSE least((page-1)*{size}, total)+1 END AS start_index,
      least(least((page-1)*{size}, total)+{size}, total) AS end_index,
      array_to_string(CASE WHEN pages<=5 THEN range(1, pages+1) WHEN page<=3 THEN range(1,6) WHEN page>=pages-2 THEN range(pages-4, pages+1)
           ELSE range(page-2, page+3) END, ',') AS page_numbers
      FROM (SELECT *, greatest(1, least({page}, pages)) AS page FROM
        (SELECT count(*) AS total, CAST(ceil(greatest(count(*),1)/{size}.0) AS BIGINT) AS pages FROM part))"""


_PAGES = [(20, 1), (50, 2), (10, 7), (100, 10_000), (20, -3)]


@query("catalogue_page_figures", "O5 O6", " UNION ALL ".join(_page_info_sql(s, p) for s, p in _PAGES))
def catalogue_page_figures(spark, sf_dir):
    o = V.objects(spark, sf_dir)
    sizes = [s if s != 20 or p > 0 else 33 for s, p in _PAGES]  # 33 is no listing size: 20 is taken
    out = None
    for size, (_, page) in zip(sizes, _PAGES):
        one = O.page_info(o, size, page)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("page_numbers", F.array_join(F.transform("page_numbers", lambda n: n.cast("string")), ","))


@query(
    "merged_sources", "U1",
    """SELECT durable_id, name, label FROM (
         SELECT *, row_number() OVER (PARTITION BY durable_id ORDER BY src, CASE src WHEN 1 THEN -position ELSE position END) AS r FROM (
           SELECT user_id AS durable_id, event_id AS position, event_type||event_id AS name, props AS label, 1 AS src FROM events WHERE event_type='click'
           UNION ALL SELECT user_id*2, event_id, event_type||event_id, props, 2 FROM events WHERE event_type<>'click')) WHERE r=1""",
)
def merged_sources(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    name = F.concat("event_type", F.col("event_id").cast("string")).alias("name")
    position, label = F.col("event_id").alias("position"), F.col("props").alias("label")
    first = e.where("event_type = 'click'").select(F.col("user_id").alias("durable_id"), position, name, label)
    second = e.where("event_type <> 'click'").select((F.col("user_id") * 2).alias("durable_id"), position, name, label)
    return O.merge_sources(first, second)
