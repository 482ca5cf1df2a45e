"""Repeated runs of documents without an id."""

import hashlib

from tidemark.llm import line_dedup


def test_runs_of_null_ids_are_repeats(spark):
    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(6))
    texts = [f"{run}\nown a", f"own b\n{run}"]
    low = -(1 << 63)
    rows = [(None, texts[0]), (None, texts[1]), (7, f"{run}\nown c"), (low, f"{run}\nown d")]
    got = sorted((r.n_deleted, str(r.doc_id), r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first, later = sorted(texts, key=lambda t: hashlib.md5(t.encode()).digest())
    left = later.replace(run, "").strip()
    assert got == sorted([(0, "None", first), (6, "None", left), (6, "7", "own c"), (6, str(low), "own d")])
