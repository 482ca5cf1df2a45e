"""Near duplicates: rows that share an id, hot buckets, and recall on a given table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, near_dedup

SCHEMA = "doc_id long, text string"


def _text(rng, n=80):
    return " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(n))


def _shingles(text, size):
    words = text.lower().split()
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def _brute(rows, size, percent):
    """Least id reachable of every row, by all pairs that share a shingle."""
    sets = [_shingles(t or "", size) for _, t in rows]
    group, by = list(range(len(rows))), {}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        met = {}
        for x in s:
            for j in by.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            by[x].append(i)
        for j, common_ in met.items():
            if 100 * common_ >= percent * (len(s) + len(sets[j]) - common_):
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [None if d is None else least[top(i)] for i, (d, _) in enumerate(rows)]


def test_rows_that_share_an_id_keep_their_own_texts(spark, sf_dir):
    rng = random.Random(1)
    alpha, beta = _text(rng), _text(rng)
    rows = [(1, alpha), (1, beta), (2, beta + " end"), (3, alpha), (3, alpha), (None, alpha), (4, None), (4, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", crowd string")
    out = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 3, 85).collect()]
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (None, None, True), (4, 4, True), (4, 4, True)]
    assert sorted(out, key=str) == sorted(want, key=str)
    left = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert left.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert kept == sorted([(1, alpha), (1, beta), (None, alpha), (4, None), (4, "")], key=str)


def test_one_row_of_a_repeated_one_stays(spark, sf_dir):
    rng = random.Random(2)
    text = _text(rng)
    docs = spark.createDataFrame([(5, text, "b"), (5, text, "a"), (5, text, None), (9, text, "c")], SCHEMA + ", lang string")
    assert [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs.repartition(3), sf_dir).collect()] == [(5, text)]


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    """A third of all rows are copies or near copies of one text; keys count as heavy from 5 rows on."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    monkeypatch.setattr(near_dedup, "HEAVY_ROWS", 5)
    rng = random.Random(3)
    base = _text(rng).split()
    rows = []
    for i in range(240):
        words = base[:] if i % 3 == 0 else _text(rng).split()
        for _ in range(rng.randint(0, 3) if i % 3 == 0 and i % 2 else 0):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        rows.append((i, " ".join(words)))
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    assert out == dict(zip((d for d, _ in rows), _brute(rows, 3, 85), strict=True))


def _near_copies(rng):
    """Copies of one text: some alike, some too far apart to link, which yet share buckets."""
    base = _text(rng).split()
    for i in range(24):
        words = base[:]
        for k in range(0, len(base), 80 if i % 3 == 0 else 20):
            words[k + rng.randrange(20)] = f"n{rng.random()}"
        yield i, " ".join(words)


def test_a_group_of_near_copies_takes_two_rounds(spark, monkeypatch):
    rows, rounds, seen = list(_near_copies(random.Random(4))), [], []
    test, whole = near_dedup.similar, near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "similar", lambda *a: rounds.append(a) or test(*a))
    monkeypatch.setattr(near_dedup, "confirmed", lambda members, *rest: seen.append(members) or whole(members, *rest))
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    assert out == dict(zip((d for d, _ in rows), _brute(rows, 3, 85), strict=True))
    assert 1 < len(set(out.values())) < len(rows) and len(rounds) == 2
    buckets = [tuple(r.nodes) for r in seen[0].groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).collect()]
    assert len(set(buckets)) == len(buckets) > 1


def test_buckets_of_too_many_centres_go_on(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CENTRES", 2)
    monkeypatch.setattr(near_dedup, "MORE_CENTRES", 2)
    rows, rounds, test = list(_near_copies(random.Random(5))), [], near_dedup.similar
    monkeypatch.setattr(near_dedup, "similar", lambda *a: rounds.append(a) or test(*a))
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    assert out == dict(zip((d for d, _ in rows), _brute(rows, 3, 85), strict=True)) and len(rounds) > 2


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_recall_on_a_given_table(spark, sf_dir, size, percent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("node", "key", "owner", "n")})
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, size, percent).collect()}
    want = dict(zip((d for d, _ in rows), _brute(rows, size, percent), strict=True))
    assert out == want and any(d != c for d, c in want.items())


def test_empty_table(spark, sf_dir):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), sf_dir).collect() == []
