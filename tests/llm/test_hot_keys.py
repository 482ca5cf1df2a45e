"""Joins whose keys may hold a third of all rows, with every key of a few rows counted as heavy."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import test_line_dedup_against_brute_force as line_dedup_against_brute_force
from tidemark.llm import common, lattice, warc


@pytest.fixture(autouse=True)
def few_rows_are_many(monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 4)


def test_join_counted(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, rng.randint(0, 60), None]), i) for i in range(400)]
    left = spark.createDataFrame(rows, "k long, v long")
    unique = left.where("k is not null and k % 3 > 0").groupBy("k").agg(F.count("v").alias("_n"), F.max("v").alias("top"))
    got = sorted(map(tuple, common.join_counted(left, unique, ["k"]).select("k", "v", "top").collect()))
    top = {}
    for k, v in rows:
        top[k] = v
    assert got == sorted((k, v, top[k]) for k, v in rows if k is not None and k % 3)
    assert common.join_counted(left, unique.where("k < 0"), ["k"]).count() == 0


def test_line_dedup_with_heavy_lines(spark):
    line_dedup_against_brute_force(spark)


def test_revisits_of_a_heavy_payload(spark):
    same, other = "x" * 150, "y" * 120
    rows = [(i, "u", same if i % 3 == 0 else other if i % 50 == 1 else f"{i} " * 60 if i % 2 else "") for i in range(120)] + [(None, "u", same)]
    folder = common.new_folder(spark, "warc")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in warc.read_records(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder), folder).collect()}
    first = {}
    for i, _, html in rows:
        if len(html) >= 100:
            first.setdefault(html, i)
    for i, _, html in rows:
        revisit = len(html) >= 100 and first[html] != i
        assert got[i] == ("revisit" if revisit else "response", first[html] if revisit else None, hashlib.sha256(html.encode()).hexdigest())


def test_scores_are_the_same_over_many_blocks(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["the", "a", "rare%d" % i, "Of"], k=12))) for i in range(60)], "doc_id long, text string")
    score = lambda size: sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 6)) for r in lattice.score_documents(docs, block_bytes=size).collect())
    assert score(50) == score(10_000_000)
