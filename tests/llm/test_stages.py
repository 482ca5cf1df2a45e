"""The pipeline stage by stage against plain Python, and all operators on empty tables and very long texts."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_benchmark_blocks import _words
from tests.llm.test_near_identity import _brute as near_brute
from tests.llm.test_tokens import _check_packing, _ids
from tidemark.llm import alignment, common, decontaminate, line_dedup, merkle, near_dedup, outliers, pii, registry, secrets, url_rules, warc

registry.load()


def _lines_brute(texts, min_words):
    """Texts without later copies of repeated runs of lines of ``min_words`` words."""
    first, out = {}, {}
    for d, text in texts:
        lines = text.split("\n")
        at = [p for p, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line)]
        size = [len(re.findall(r"[^\x20\x09-\x0D]+", lines[p])) for p in at]
        gone = set()
        for i in range(len(at)):
            n, run = 0, 0
            for j in range(i, len(at)):
                n, run = n + size[j], hash((run, lines[at[j]]))
                if n < min_words:
                    continue
                e, s = first.setdefault((run, j - i), (d, i))
                a = max(i, s + j - i + 1) if e == d else i
                if (e, s) != (d, i) and a <= j:
                    gone |= set(range(at[a], at[j] + 1))
        out[d] = "\n".join(line for p, line in enumerate(lines) if p not in gone)
    return out


def _cut_brute(text, items, window=10, most=0.5):
    words = _words(text)
    hit = set()
    for found in items:
        n = min(window, len(found))
        grams = {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if found else set()
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in grams:
                hit |= set(range(p, p + n))
    return None if words and len(hit) > most * len(words) else [w for p, w in enumerate(words) if p not in hit]


def test_stages_against_brute_force(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    steps, folder = {}, common.new_folder(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = steps[name] = spark.read.parquet(f"{folder}/{name}")
    rows = {n: sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()) for n, d in steps.items() if n != "packing"}
    given = dict(sorted((r.doc_id, r.text) for r in common.read_table(spark, sf_dir, "documents").collect()))
    good = {r.doc_id for r in outliers.judge(common.read_table(spark, sf_dir, "documents")).collect() if r.kept}
    assert rows["quality_rules"] == [(d, t) for d, t in given.items() if d in good] and 0 < len(good) < len(given)
    left = _lines_brute(rows["quality_rules"], line_dedup.MIN_WORDS)
    texts = dict(rows["quality_rules"])
    assert rows["line_dedup"] == [(d, t) for d, t in left.items() if t == texts[d] or re.search(r"[^\x20\x09-\x0D]", t)]
    least = near_brute(rows["line_dedup"], 5, 80)
    assert rows["near_dedup"] == [r for r, c in zip(rows["line_dedup"], least, strict=True) if r[0] == c] and len(rows["near_dedup"]) < len(rows["line_dedup"])
    items = [_words(r.text) for r in common.read_table(spark, sf_dir, "benchmark").collect()]
    cut = {d: _cut_brute(t, items) for d, t in rows["near_dedup"]}
    assert {d: _words(t) for d, t in rows["decontaminate"]} == {d: w for d, w in cut.items() if w is not None}
    _check_packing(steps["packing"].collect(), dict(zip((d for d, _ in rows["decontaminate"]), _ids([t for _, t in rows["decontaminate"]], 2), strict=True)))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = "item_id long, text string"


@pytest.mark.parametrize("name", ["secrets", "lines", "outliers", "near", "hits", "urls", "warc", "manifest", "personal", "alignment", "pipeline"])
def test_empty_tables(spark, sf_dir, name):
    docs = spark.createDataFrame([], SCHEMA)
    if name == "pipeline":
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.collect() == []
        assert corpus_pipeline.packing(spark, docs, sf_dir).collect() == []
        return
    pages, folder = spark.createDataFrame([], "page_id long, url string, html string"), common.new_folder(spark, "warc")
    run = {
        "secrets": lambda: secrets.find_secrets(docs), "lines": lambda: line_dedup.dedup_lines(docs), "outliers": lambda: outliers.judge(docs),
        "near": lambda: near_dedup.near_duplicates(docs), "hits": lambda: decontaminate.find_hits(docs, spark.createDataFrame([(1, "a")], BENCH)),
        "urls": lambda: url_rules.judge(pages), "warc": lambda: warc.read_records(warc.write_archives(pages, folder), folder),
        "manifest": lambda: merkle.manifest(docs), "personal": lambda: pii.find_personal(docs), "alignment": lambda: alignment.align_documents(docs),
    }
    assert run[name]().collect() == []


def test_very_long_texts(spark):
    """A text of a few megabytes, of many lines and of one, beside a short one."""
    long = [(1, "\n".join(f"line {i} of word{i % 977} and some more" for i in range(40_000))), (2, "x" * 1_500_000), (3, "short " * 60)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in long], SCHEMA).withColumn("spans", F.lit("x"))
    judged = {r.doc_id: (r.n_words, r.word_chars) for r in outliers.judge(docs).collect()}
    assert judged == {d: (len(t.split()), sum(map(len, t.split()))) for d, t in long}
    assert {r.doc_id: len(r.spans) for r in secrets.find_secrets(docs).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: len(r.spans) for r in pii.find_personal(docs).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: (r.n_lines, r.n_deleted) for r in line_dedup.dedup_lines(docs).collect()} == {1: (40_000, 0), 2: (1, 0), 3: (1, 0)}
    bench = spark.createDataFrame([(7, "line 39999 of word919 and some more")], BENCH)
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.digest(decontaminate.find_hits(docs, bench)).collect()}
    assert found == {1: (280_000, 7), 2: (1, 0), 3: (60, 0)}
    assert {r.doc_id: r.verified for r in merkle.manifest(docs).collect()} == {1: True, 2: True, 3: True}
    assert {r.doc_id: r.kept for r in near_dedup.near_duplicates(docs).collect()} == {1: True, 2: True, 3: True}
