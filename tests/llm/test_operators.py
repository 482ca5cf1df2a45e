"""Operators and pipeline on small rows with every awkward case, and the queries with SQL."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import rows_of
from tidemark.llm import common, dac, decontaminate, lattice, line_dedup, near_dedup, outliers, packing, registry, secrets, url_rules, warc

registry.load()

LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [
    (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"),
    (2, None, None, "a"), (3, "", "en", None), (4, " \n\t", "en", "a"), (None, "one two three four five six seven", "en", "b"),
    (5, LONG, "en", "a"), (6, LONG + " tail", "en", "a"), (7, "short", "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with columns named like the operators' own."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    clash = {c: F.lit("x") for c in ("_row", "_text", "doc", "text_id", "n_words", "hits", "items", "x0", "kept", "_lang", "key", "n_lines")}
    return rows.withColumns(clash)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = registry.QUERIES[name](spark, sf_dir)
    cur = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(2, 7))] for _ in range(6)]
    texts = []
    for i in range(25):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice([rng.choice(blocks), [f"only {i} {rng.random()}"], [""]])
        texts.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), 6).collect()}
    first, want = {}, {}
    for d, text in texts:
        lines = text.split("\n")
        at = [p for p, line in enumerate(lines) if line.split()]
        gone = set()
        for i in range(len(at)):
            for j in range(i, len(at)):
                run = tuple(lines[p] for p in at[i : j + 1])
                if sum(len(line.split()) for line in run) < 6:
                    continue
                e, s = first.setdefault(run, (d, i))
                a = max(i, s + len(run)) if e == d else i
                if (e, s) != (d, i) and a <= j:
                    gone |= set(range(at[a], at[j] + 1))
        want[d] = "\n".join(line for p, line in enumerate(lines) if p not in gone)
    assert got == want and any(want[d] != t for d, t in texts)


def test_near_duplicates_against_brute_force(spark, docs):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(30)]
    for i in range(60):
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        rows.append((100 + i, " ".join(words)))
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert out == group
    odd = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(docs, 3, 85).collect())
    assert odd == sorted([(1, 5, 1, True), (1, 5, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (-1, 5, -1, True), (5, 2998, 5, True), (6, 2999, 5, False), (7, 1, 7, True)])


def test_statistics_and_outliers(spark, docs):
    out = outliers.judge(docs).collect()
    assert len(out) == len(ROWS)
    for r in out:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.base_failed == (len(words) < 50) and r.kept == (not r.base_failed)
    text = "a b c x a b c d\na b\n\na b\n$ # q"
    [r] = outliers.judge(spark.createDataFrame([(1, text, "en", "s")], SCHEMA)).collect()
    assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (2, 1, 6)
    assert outliers.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def _text(rng, n, repeated=0, ruled=0, marks=0, long=False):
    """``n`` or more words in lines of ten; with words said twice, equal short lines, symbols, or long words."""
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(3, 9) * (3 if long else 1))) for _ in range(n - repeated)]
    words += words[:repeated]
    words[5:5] = ["#"] * marks
    lines = [" ".join(words[i : i + 10]) for i in range(0, len(words), 10)]
    for i in range(ruled):
        lines.insert(2 * i, "read more")
    return "\n".join(lines)


def _plant(rng, spread):
    """(id, text) of clean texts, and of outliers in each statistic with ids from 1000."""
    clean = [_text(rng, n, repeated=rng.choice([0, 0, 0, 0, 3])) for n in spread]
    planted = [_text(rng, 200, long=True), _text(rng, 200, marks=60), _text(rng, 250, ruled=20), _text(rng, 200, repeated=40), _text(rng, 100, repeated=24)]
    return [*enumerate(clean), *enumerate(planted, 1000)]


def _brute(rows):
    """Ids kept by determinants over many starts, rows and not classes being ranked."""
    rng = np.random.default_rng(1)
    n = np.array([r.n_words for r in rows], float)
    x = np.array([[np.log(r.word_chars / r.n_words), *(np.sqrt(v / r.n_words) for v in (r.n_symbols, r.n_dup_lines, r.n_repeat_words))] for r in rows])
    errors = np.zeros((len(n), 4, 4))
    errors[:, 2, 2], errors[:, 3, 3] = 0.25 / n, 1.5 / n
    floors = np.diag([0.05**2, 0.05**2, 0, 0])
    estimate = lambda at, factor: (x[at].mean(0), factor * np.cov(x[at].T, bias=True) + floors)
    apart = lambda m, c: np.einsum("ni,nij,nj->n", x - m, np.linalg.inv(c + errors), x - m)
    best = None
    for _ in range(60):
        m, c = estimate(rng.choice(len(n), 8, replace=False), 1.0)
        for _ in range(15):
            core = np.argsort(apart(m, c), kind="stable")[: int(np.ceil(0.75 * len(n)))]
            m, c = estimate(core, outliers.consistency(0.75))
        det = np.linalg.slogdet(c + errors[core].mean(0))[1]
        if best is None or det < best[0]:
            best = det, m, c
    m, c = estimate(apart(*best[1:]) <= outliers.chi2_quantile(0.975, 4), outliers.consistency(0.975))
    return {r.doc_id for r, d in zip(rows, apart(m, c), strict=True) if d <= outliers.chi2_quantile(0.999, 4)}


def test_outliers_against_brute_force(spark):
    rng = random.Random(21)
    rows = [(i + shift, t, lang, "a") for shift, lang in ((0, "en"), (5000, "de")) for i, t in _plant(rng, [rng.randint(60, 600) for _ in range(90)])]
    out = outliers.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not any(r.base_failed for r in out)
    kept = {r.doc_id for r in out if r.kept}
    assert kept == _brute([r for r in out if r.lang == "en"]) | _brute([r for r in out if r.lang == "de"])
    assert kept == {i for i, *_ in rows if i % 5000 < 1000}


def test_odd_rows_through_the_other_operators(spark, docs):
    assert sorted(r.n_deleted for r in line_dedup.dedup_lines(docs).collect()) == [0] * len(ROWS)
    pieces = packing.pack(docs, with_ids=True).collect()
    assert sum(p.length for p in pieces) == sum(len(p.ids) for p in pieces) and {p.doc_id for p in pieces} == {r[0] for r in ROWS}
    folder = common.new_folder(spark, "dac")
    back = dac.read_dac(dac.write_dac(docs, folder), folder).collect()
    assert len(back) == len(ROWS) and sorted(b.start for b in back)[0] == 0
    assert sum(b.n_tokens for b in back) == sum(p.length for p in pieces)
    bench = spark.createDataFrame([(9, " ".join(f"WORD{i}" for i in range(5, 40))), (8, None), (None, "two three")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.digest(decontaminate.find_hits(docs, bench)).collect()}
    assert (found[5].n_hit, found[5].n_items, found[1].n_hit, found[2].n_words) == (35, 1, 2, 0)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()}[1] == "one four five six seven"
    scored = lattice.score_documents(docs).collect()
    assert len(scored) == len(ROWS) and {r.n_tokens for r in scored if r.doc_id in (2, 3, 4)} == {1}
    assert {r.spans[0].kind if r.spans else None for r in secrets.find_secrets(docs).collect()} == {None}


def test_secrets_where_most_candidates_are_bare_keys(spark):
    rng = random.Random(11)
    key = lambda: "sk_" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    some = lambda n: rng.sample(words, n)
    rows, bare, other = [], set(), set()
    for i in range(120):
        keys, long = [key() for _ in range(10)], "-".join([*some(4), str(rng.randint(1, 99))])
        bare.update(keys)
        other.add(long)
        rows.append((i, " ".join([*some(30), f"api_key: {key()}", *some(5), long, *some(5), *keys, *some(5)])))
    texts = dict(rows)
    found = {texts[r.doc_id][s.start : s.end] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans if s.kind == "format"}
    assert len(found & bare) >= 0.95 * len(bare) and not found & other


def test_ordinary_tokens_of_tasks_hold_the_smallest_of_all():
    rng = random.Random(12)
    parts = [{f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(0, 900))} for _ in range(12)]
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    handed = set()
    for task in (parts[:5], parts[5:]):
        smallest = secrets.Smallest(50)
        for part in task:
            handed.update(smallest.add(part))
    assert sorted(handed, key=digest)[:50] == sorted(set().union(*parts), key=digest)[:50]
    text = "my-token=abcdefgh1/x plain ab12 well-known x9y8x7w6v5u4t3s2r1q0 " + "0f" * 20 + "tail end"
    assert secrets.ordinary(text, secrets.base_spans(text)[0]) == {"plain", "ab12", "well-known", "end"}


def test_warc_round_trip(spark):
    same, url = "<p>" + "x" * 200, "http://a.example.org/\r\nz"
    rows = [(3, url, same), (1, None, same), (2, "u", same), (4, "u", None), (5, "u", ""), (6, "u", "é" * 49), (7, "u", "é" * 49), (None, "u", same)]
    folder = common.new_folder(spark, "warc")
    out = warc.read_records(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder), folder).collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1] == (203, sha(same), "response", None) and got[3] == got[2] == got[None] == (203, sha(same), "revisit", 1)
    assert got[4] == got[5] == (0, sha(""), "response", None) and got[6] == got[7] == (98, sha("é" * 49), "response", None)


def test_urls(spark):
    urls = ["http://ORG/x", "https://a.b.org/", "http://example.org/es/1", "x.example.org/en/1", "http://x.example.org/en/1?a", "http://evil.com/x.org/fr/", None, "://", "http://a.com", "http://m.q.net/"]
    out = {r.url: (r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame([(u, "x") for u in urls], "url string, host string")).collect()}
    assert [out[u] for u in urls] == [
        ("org/", "allow"), ("org/", "allow"), ("example.org/es/", "block"), (None, "allow"), ("example.org/en/1", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"),
    ]


def test_pipeline(spark, sf_dir, docs):
    """Every stage keeps the columns and only what its operator keeps."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
