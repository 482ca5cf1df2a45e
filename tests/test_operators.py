"""Registry, storage, naming and skew operators on hand-written rows."""

import json
import random

from pyspark.sql import functions as F

from tidemark.functions import naming as M
from tidemark.functions.coerce import coerce, invalid
from tidemark.functions.schema import schema_table, struct_type
from tidemark.operators import registry as R
from tidemark.operators import storage as S
from tidemark.operators.catalog import page_info
from tidemark.operators.skew import in_order, running, split_hot
from tidemark.operators.snapshot import upsert_snapshot
from tidemark.sources import describe as D
from tidemark.sources.store import row_count


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_names(spark):
    lit = F.lit
    assert one(spark, M.prefixed_table_name(lit("  salt & pepper "), lit("Order__c"))) == "ORG_SALT_PEPPER_ORDER_C"
    long = one(spark, M.prefixed_table_name(lit("the longest of all possible names"), lit("Another_quite_long_thing__c")))
    assert len(long) <= 30 and one(spark, lit(long).rlike("^[A-Z_][A-Z0-9_]*$"))
    assert one(spark, M.prefixed_table_name(lit("ignored"), lit("org_x_y"))) == "ORG_X_Y"
    masks = {"": None, "q": "*", "qr": "**", "qrs": "q***", "qrst": "q***", "quince": "qu******ce"}
    for text, want in masks.items():
        assert one(spark, M.mask(lit(text))) == want, text
    assert one(spark, M.first_non_blank(lit("\t"), lit("z"))) == "z"
    assert one(spark, M.org_key(lit("https://H.example.net/p?x=1\n"))) == "h.example.net"
    assert one(spark, M.org_key(lit("<http://tide.example.net/a|Tide>"))) == "tide.example.net"
    assert one(spark, M.org_key(lit("\t\n"))) == ""
    schemas = {"9 lives": "org_org_9_lives", "***": "org_org_default", "Two\tWords": "org_two_words"}
    for text, want in schemas.items():
        assert one(spark, M.org_schema_name(lit(text))) == want, text


def test_connections(spark):
    cases = {
        ("POSTGRESQL", "jdbc:postgresql://pg.test:6000/lake"): ("pg.test", 6000, "lake", None, None),
        ("ORACLE", "jdbc:oracle:thin:@ora.test:1600:ORCL"): ("ora.test", 1600, None, None, "ORCL"),
        ("ORACLE", "jdbc:oracle:thin:@//ora.test:1600/sales"): ("ora.test", 1600, None, "sales", None),
        ("MYSQL", "my.test"): ("my.test", 3306, None, None, None),
        ("MARIADB", "jdbc:mariadb://maria.test/shop"): ("maria.test", 3306, "shop", None, None),
        ("POSTGRESQL", "??"): (None,) * 5,
    }
    for (vendor, url), want in cases.items():
        c = one(spark, M.connection(F.lit(vendor), F.lit(url)))
        assert tuple(c) == want, url
    built = M.connection_url(F.lit("ORACLE"), F.lit("ora.test"), F.lit(1600), F.lit(None), F.lit(None), F.lit("ORCL"))
    assert one(spark, built) == "jdbc:oracle:thin:@ora.test:1600:ORCL"


def test_storage_registration(spark):
    schema = "name string, vendor string, auth_method string, raw_url string, port int, username string, schema_name string, password string"
    rows = [
        ("lake", "POSTGRESQL", "PASSWORD", "jdbc:postgresql://pg.test:6000/lake", None, "loader", "Raw Zone", "x"),
        ("sales", "ORACLE", "PASSWORD", "jdbc:oracle:thin:@ora.test:1600:ORCL", None, "loader", "ORCL", "x"),
        ("nobody", "ORACLE", "PASSWORD", "jdbc:oracle:thin:@ora.test:1600:ORCL", None, "\t", " ", "x"),
    ]
    df = spark.createDataFrame(rows, schema)
    reasons = {r["name"]: r.reject_reason for r in S.validate(df).collect()}
    assert reasons == {"lake": None, "sales": None, "nobody": "schema_context"}
    out = {r["name"]: r for r in S.normalize(df).collect()}
    assert (out["lake"].host, out["lake"].port, out["lake"].schema_name) == ("pg.test", 6000, "org_raw_zone")
    assert out["sales"].jdbc_url == rows[1][3]
    assert (out["sales"].sid, out["sales"].service_name, out["sales"].schema_name) == ("ORCL", None, "LOADER")


def test_several_incoming_rows_of_a_key(spark):
    """Every keyed write leaves one row per key; the rows apply one after the other."""
    stored = spark.createDataFrame([("a", "x", "old", "k")], "org_key string, obj string, v string, w string")
    new = spark.createDataFrame([("a", "x", "1", "p"), ("a", "x", "2", "q"), ("b", "y", "3", "r")], stored.schema)
    assert sorted(map(tuple, R.upsert(stored, new.coalesce(1), ["org_key", "obj"], ["w"]).collect())) == [("a", "x", "2", "k"), ("b", "y", "3", "r")]
    updates = spark.createDataFrame([("a", 2, " ", "m2"), ("a", 1, "n1", "m1"), ("a", 0, "n0", None)], "org_key string, n int, v string, w string")
    merged = R.merge_attributes(stored.select("org_key", "v", "w"), updates.repartition(3), "org_key", order="n")
    assert [tuple(r) for r in merged.collect()] == [("a", "n1", "m2")]
    heads = spark.createDataFrame([(1, "n", "d", "VERIFIED")], "id int, name string, description string, connection_status string")
    edits = spark.createDataFrame([(1, "n1", "d1"), (1, "n2", "d2")], "id int, name string, description string").coalesce(1)
    assert [tuple(r) for r in S.edit(heads, edits).collect()] == [(1, "n2", "d2", "PENDING")]


def test_snapshot_with_repeated_keys(spark):
    schema = "sfid string, v int, _oc_last_modified_at timestamp, _oc_last_event_at timestamp"

    def rows(*values):
        return spark.createDataFrame([], schema) if not values else spark.createDataFrame(list(values), "sfid string, v int, m string, e string").selectExpr(
            "sfid", "v", "cast(m as timestamp) _oc_last_modified_at", "cast(e as timestamp) _oc_last_event_at").coalesce(1)

    new = rows(("a", 1, "2024-01-02", None), ("a", 2, "2024-01-01", None), ("b", 3, "2024-01-01", None), ("b", 4, "2024-01-01", None))
    for guard in ("column", "row"):
        out = upsert_snapshot(rows(), new, guard=guard).collect()
        assert sorted((r.sfid, r.v) for r in out) == [("a", 1), ("b", 4)]
        out = upsert_snapshot(rows(("a", 9, "2024-01-03", None)), new, guard=guard).collect()
        assert sorted((r.sfid, r.v) for r in out) == [("a", 9), ("b", 4)]


def test_describe(spark, tmp_path):
    listed = [
        {"name": "Id", "type": "id", "length": 18, "label": "Key"},
        {"name": "Title", "type": "string", "length": 80, "label": "Title"},
        {"name": "Notes", "type": "textarea", "length": 20000, "label": "What's new"},
        {"name": "SeenAt", "type": "datetime", "length": 0, "label": "Seen"},
    ]
    (tmp_path / "d.json").write_text(json.dumps({"fields": listed}))
    fields = D.describe_fields(spark, str(tmp_path))
    my = {r.column_name: (r.column_type, r.comment) for r in schema_table(fields, "MYSQL").collect()}
    assert my["sfid"][0] == "VARCHAR(18)" and my["Title"][0] == "VARCHAR(80)" and my["Notes"] == ("TEXT", "What`s new")
    assert my["SeenAt"][0] == my["_oc_last_event_at"][0] == "DATETIME(6)"
    assert {r.column_type for r in schema_table(fields, "ORACLE").collect()} >= {"VARCHAR2(18)", "CLOB", "TIMESTAMP(6)"}
    st = struct_type([r.asDict() for r in fields.collect()])
    assert st.names == ["sfid", "Title", "Notes", "SeenAt", "_oc_last_modified_at", "_oc_last_event_at"]
    assert not st["sfid"].nullable and st["Notes"].metadata["comment"] == "What`s new"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text('{"records":[{"Id":"a"},{"Id":"b","N":{"x":1}}]}')
    assert D.snapshot_records(spark, str(tmp_path / "p")).count() == 2


def test_coercion_edges(spark):
    def both(text, kind):
        return one(spark, F.struct(coerce(F.lit(text), kind).cast("string"), invalid(F.lit(text), kind)))

    cases = [
        ("2024-01-02T03:04:05.123+0000", "datetime", "2024-01-02 03:04:05.123", False),
        ("2024-01-02T03:04:05.123456789Z", "datetime", "2024-01-02 03:04:05.123456", False),
        ("2024-01-02T03:04", "datetime", "2024-01-02 03:04:00", False),
        ("2024-01-02", "datetime", None, True),
        ("2024", "datetime", "1970-01-01 00:33:44", False),
        ("1700000000000", "datetime", "2023-11-14 22:13:20", False),
        ("", "datetime", None, False),
        ("2024-13-01", "date", None, True),
        ("1700000000", "date", "2023-11-14", False),
        ("99999999999999999", "datetime", None, True),
        ("-9223372036854775808", "datetime", None, True),
        ("123456789012345678901234567890", "datetime", None, True),
        ("10:00:00.000Z", "time", "10:00:00", False),
        ("10:00", "time", "10:00:00", False),
        ("10:00:00+09:00", "time", "01:00:00", False),
        ("25:00:00", "time", None, True),
        ("Infinity", "double", None, True),
        ("1e400x", "double", None, True),
        ("anything", "picklist", "anything", False),
    ]
    for text, kind, value, bad in cases:
        assert tuple(both(text, kind)) == (value, bad), (text, kind)


def test_upsert_null_keys_never_match(spark):
    schema = "org_key string, obj string, n int, born int"
    stored = spark.createDataFrame([("a", "x", 1, 1), (None, "x", 2, 2)], schema)
    new = spark.createDataFrame([("a", "x", 10, 10), (None, "x", 20, 20), ("b", "y", 30, 30)], schema)
    out = R.upsert(stored, new, ["org_key", "obj"], ["born"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("a", "x", 10, 1), (None, "x", 2, 2), (None, "x", 20, 20), ("b", "y", 30, 30)], key=str
    )


def test_defaults_and_fallbacks(spark):
    none = spark.createDataFrame([], "org_key string, org_name string, instance_name string, org_type string, is_sandbox boolean, my_domain string")
    [row] = R.first_org(none, "k").collect()
    assert (row.org_key, row.org_name, row.is_sandbox) == ("k", "-", False)
    orgs = spark.createDataFrame([("a", False)], "org_key string, is_default boolean")
    out = R.default_for_first(orgs, spark.createDataFrame([("c",), ("b",)], "org_key string"))
    assert {r.org_key: r.is_default for r in out.collect()} == {"a": False, "b": True, "c": False}
    again = R.default_for_first(out, spark.createDataFrame([("0",)], "org_key string"))
    assert {r.org_key: r.is_default for r in again.collect()}["0"] is False
    empty = spark.createDataFrame([], "name string")
    [p] = page_info(empty, 20, 3).collect()
    assert (p.total, p.pages, p.page, p.start_index, p.end_index, p.page_numbers) == (0, 1, 1, 0, 0, [1])
    assert row_count(spark, "no_such_table") == 0


def test_history_is_appended(spark, tmp_path):
    path = str(tmp_path / "history")
    for kind in ("TEST", "REGISTER"):
        R.append_history(spark.createDataFrame([(1, kind)], "storage_id long, event_type string"), path)
    assert spark.read.parquet(path).count() == 2


def test_running_values_of_hot_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.randrange(-5, 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    totals = {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}

    def result(limit, inclusive, keys=("k",)):
        return sorted(map(tuple, running(df, list(keys), ["seq"], totals, inclusive, limit, limit).select("seq", "s", "m").collect()))

    for inclusive in (True, False):
        assert result(60, inclusive) == result(10_000, inclusive)
        assert result(60, inclusive, ()) == result(10_000, inclusive, ())
    cold, hot, keys = split_hot(df, ["k"], 200)
    assert [r.k for r in keys.collect()] == ["hot"]
    assert {r.k for r in hot.select("k").distinct().collect()} == {"hot"} and cold.count() + hot.count() == len(rows)
    assert split_hot(df, ["k"], 1000)[1] is None



def test_places_follow_the_order(spark):
    rows = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = in_order(rows.orderBy(F.desc("g"), "id")).collect()
    want = sorted(range(1000), key=lambda i: (-(i % 3), i))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(1, 1001))
    assert in_order(rows.where("id < 0").orderBy("id")).count() == 0


def test_history_events(spark):
    routes = spark.createDataFrame(
        [("o1", "Lead", "CDC", "ACTIVE"), ("o1", "Case", "CDC", "FAILED"), ("o2", "Lead", "STREAMING", None)],
        "org_key string, selected_object string, routing_protocol string, routing_status string",
    )
    changes = spark.createDataFrame(
        [
            (1, "o1", "Lead", "CDC", "FAILED", "lost", "ann"), (2, "o1", "Lead", "CDC", "RELEASED", "by hand", "bob"),
            (3, "o2", "Lead", "STREAMING", "RECOVERED", None, "bob"), (4, "o1", "Case", "CDC", "PAUSED", None, "bob"),
            (5, "o9", "Lead", "CDC", "FAILED", None, "bob"),
        ],
        "n int, org_key string, selected_object string, routing_protocol string, to string, message string, actor string",
    )
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    got = R.transition_events(routes, changes, at, order="n").drop("event_at").collect()
    assert {tuple(r) for r in got} == {
        ("o1", "Lead", "CDC", "RELEASED", "ACTIVE", "RELEASED", "by hand", "bob"),
        ("o2", "Lead", "STREAMING", "RECOVERED", None, "ACTIVE", None, "bob"),
    }
    tests = spark.createDataFrame([(1, True, "fine"), (1, False, "shut"), (2, None, "?"), (9, True, "x")], "id int, success boolean, message string")
    heads = spark.createDataFrame([(1,), (2,)], "id int")
    got = S.test_events(heads, tests.withColumn("tested_at", at), "REGISTER").drop("tested_at").collect()
    assert {tuple(r) for r in got} == {(1, "REGISTER", True, None), (1, "REGISTER", False, "shut"), (2, "REGISTER", None, None)}


def test_deep_pages_read_one_range(spark, tmp_path):
    from tidemark.operators.order_index import index_order

    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("g"))
    order = [F.col("g").desc_nulls_first(), F.col("k").asc()]
    index = index_order(rows, order, str(tmp_path / "listing"), range_rows=250)
    want = [r.id for r in rows.orderBy(*order).collect()]
    assert index.total().first().total == 5000
    for page, size in ((1, 10), (251, 10), (500, 10), (7, 333), (501, 10), (16, 333), (1, 5000)):
        assert [r.id for r in index.page(page, size).collect()] == want[(page - 1) * size : page * size]
    assert len({f.split("_range=")[1].split("/")[0] for f in index.page(300, 10).inputFiles()}) == 1
    none = index_order(rows.where("id < 0"), order, str(tmp_path / "none"))
    assert none.page(1, 10).collect() == [] and none.total().first().total == 0


def test_a_long_listing_of_small_ranges_has_few_of_them(spark, tmp_path):
    from tidemark.operators.order_index import RANGE_ROWS, RANGES, index_order, range_count
    from tidemark.session import subfolders

    rows = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(7)).alias("g"), "id")
    order = [F.col("g").desc(), F.col("id").asc()]
    index = index_order(rows, order, str(tmp_path / "listing"), range_rows=5)
    assert len(subfolders(spark, str(tmp_path / "listing" / "rows"))) <= RANGES
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    for page in (1, 31, 60, 61):
        assert [tuple(r) for r in index.page(page, 50).collect()] == want[(page - 1) * 50 : page * 50]
    assert index.total().first().total == 3000
    assert [range_count(n, 100) for n in (0, 1, 250, 25_600)] == [1, 1, 3, 256]
    # Few ranges of bounded size, and from some length on more of them.
    assert range_count(36_000_000, 100) == 360 == 36_000_000 // RANGE_ROWS


def test_mean_sync_time_of_many_routes(spark, tmp_path):
    from tidemark.plans.registry_queries import release_unsynced_routes

    # The microseconds of 20,000 routes of one organisation add up to more than 64 bits.
    customers = spark.range(20_000).select(
        F.col("id").alias("c_custkey"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("c_name"), F.lit(1).alias("c_nationkey"),
        F.lit(10.0).alias("c_acctbal"), F.lit("HOUSEHOLD").alias("c_mktsegment"),
    )
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    out = release_unsynced_routes(spark, str(tmp_path))
    got = {r.routing_status: (r.n, r.least, r.most) for r in out.withColumn("i", F.substring("selected_object", 2, 9).cast("int")).groupBy("routing_status").agg(
        F.count("i").alias("n"), F.min("i").alias("least"), F.max("i").alias("most")).collect()}
    assert got == {"RELEASED": (10_000, 0, 9_999), "ACTIVE": (10_000, 10_000, 19_999)}


def test_rows_of_few_row_groups_are_spread(spark):
    from tidemark.session import spread

    cores = spark.sparkContext.defaultParallelism
    # As many splits as cores, of which one holds all rows.
    lumped = spark.range(0, 4000, 1, cores).where("id < 1000")
    sizes = [r["count"] for r in spread(lumped).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 1000 / cores
    many = spark.range(0, 4000, 1, 8 * cores)
    assert spread(many) is many


def test_applied_changes_are_normalised_once(spark, sf_dir, monkeypatch):
    from tidemark.plans import event_queries as Q

    read = []
    apply = Q.K.apply_mutations
    monkeypatch.setattr(Q.K, "apply_mutations", lambda m, *a, **k: read.append(m) or apply(m, *a, **k))
    Q.change_feed_applied(spark, sf_dir).collect()
    assert "from_json" not in read[0]._jdf.queryExecution().optimizedPlan().toString()
