"""Batch planning against a sequential loop, and directory scans."""

import json
import random

from tidemark.operators import files as B


def next_fit(sizes, max_items, max_bytes):
    batch, count, used, out = 0, 0, 0, []
    for size in sizes:
        if count and (count >= max_items or used + size > max_bytes):
            batch, count, used = batch + 1, 0, 0
        out.append((batch, count))
        count, used = count + 1, used + size
    return out


def plan(spark, roots, limit, **limits):
    rows = [(root, f"f{i:06d}", int(s)) for root, sizes in roots.items() for i, s in enumerate(sizes)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "root string, path string, size bigint")
    got = B.plan_batches(df, block_rows=limit, **limits).orderBy("root", "path").collect()
    out = {}
    for r in got:
        out.setdefault(r.root, []).append((r.batch_no, r.position))
    return out


def test_limits(spark):
    roots = {"tiny": [1] * 26, "big": [5, 11, 5, 5], "exact": [4, 6, 1], "zero": [0] * 60}
    got = plan(spark, roots, 1000, max_items=25, max_bytes=10)
    assert got["tiny"] == next_fit(roots["tiny"], 25, 10) and got["tiny"][10] == (1, 0)
    assert [b for b, _ in got["big"]] == [0, 1, 2, 2]  # the large file travels alone
    assert [b for b, _ in got["exact"]] == [0, 0, 1]  # a sum at the limit stays
    assert got["zero"][24:26] == [(0, 24), (1, 0)]


def test_blocks_match_the_loop(spark):
    rng = random.Random(5)
    roots = {
        "hot": [rng.choice([0, 1, 3, 50, 400, 2000]) for _ in range(900)],
        "cold": [rng.randrange(300) for _ in range(40)],
        "one": [7],
    }
    want = {r: next_fit(s, 25, 1000) for r, s in roots.items()}
    for limit in (10_000, 100, 17):
        assert plan(spark, roots, limit, max_items=25, max_bytes=1000) == want
    want = {r: next_fit(s, 3, 1000) for r, s in roots.items()}
    assert plan(spark, roots, 60, max_items=3, max_bytes=1000) == want


def test_many_blocks_of_a_huge_root(spark):
    """Blocks as short as a batch, entered at every place; batches that end with a block or the root."""
    rng = random.Random(9)
    roots = {f"r{n}": [rng.choice([0, 1, 4, 9, 30]) for _ in range(n)] for n in (1, 4, 5, 6, 10, 11, 399, 400)}
    want = {r: next_fit(s, 5, 10) for r, s in roots.items()}
    assert plan(spark, roots, 5, max_items=5, max_bytes=10) == want


def test_no_files(spark):
    none = spark.createDataFrame([], "root string, path string, size bigint")
    out = B.plan_batches(none)
    assert out.columns == ["root", "path", "size", "batch_no", "position"] and out.count() == 0


def test_directory_scan_and_summary(spark, tmp_path):
    assert B.scan_directory(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "b.txt").write_bytes(b"hello")
    (tmp_path / "in" / "deep" / "a.bin").write_bytes(b"\x00" * 9)
    files = B.scan_directory(spark, str(tmp_path / "in"), content=True)
    assert {(r.file_name, r.size) for r in files.collect()} == {("b.txt", 5), ("a.bin", 9)}
    payload = {json.loads(r.payload)["Title"]: json.loads(r.payload)["VersionData"] for r in B.upload_payloads(files).collect()}
    assert payload["b.txt"] == "aGVsbG8="
    plan_ = B.plan_batches(files.drop("content"))
    results = plan_.where("file_name = 'b.txt'").selectExpr("root", "batch_no", "position", "true success", "'ok' message")
    out = B.item_outcomes(plan_, results)
    assert {(r.file_name, r.success, r.message) for r in out.collect()} == {("b.txt", True, "ok"), ("a.bin", False, "NO_RESULT")}
    name = B.write_summary(out, str(tmp_path / "history"), "20240101-000000")
    assert (tmp_path / "history" / "upload-20240101-000000.json").is_file()
    [total] = spark.read.option("multiLine", True).json(name).collect()
    assert (total.total_count, total.success_count, total.failure_count) == (2, 1, 1)
    [p] = B.progress(out).collect()
    assert (p.processed, p.percent) == (1, 50.0)
    empty = B.scan_directory(spark, str(tmp_path / "missing"))
    assert B.plan_batches(empty).count() == 0
