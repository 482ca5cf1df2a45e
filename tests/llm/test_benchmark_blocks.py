"""Benchmark items in several bounded blocks: repeated, comma-separated and very long ones."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words, hit, names = _words(text), set(), set()
        for name, item in items:
            found = _words(item)
            n = min(window, len(found))
            for i in range(len(found) - n + 1 if found else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == found[i : i + n]:
                        hit |= set(range(p, p + n))
                        names.add("null" if name is None else str(name))
        out.append((doc_id, len(words), len(hit), sorted(names)))
    return sorted(out, key=str)


def test_blocks_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 3)))
    items = [(i, rng.choice([",", " ", ", ", "\t"]).join(word() for _ in range(rng.randint(1, 30)))) for i in range(40)]
    items += items[:15] + [(None, "ab,cd"), (90, None), (91, ",;"), (92, ",".join(word() for _ in range(400))), (items[0][0], "other text of one id")]
    docs = [(d, " ".join([*(word() for _ in range(20)), (rng.choice(items)[1] or "").upper(), *(word() for _ in range(20))])) for d in range(60)]
    docs += [(100, None), (101, ""), (102, "AB CD"), (103, "x " * 20_000 + "ab,cd")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("hits", "items", "n_words", "block")})
    want = _brute(docs, items)
    for block_words in (60, 1_000_000):
        out = decontaminate.find_hits(frame, bench, block_words=block_words).select("_row.doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), "items").collect()
        assert sorted([tuple(r) for r in out], key=str) == want
    files = decontaminate.automata(bench, common.new_folder(spark, "automata"), block_words=60)
    total = sum(len(_words(t)) for t in {t for _, t in items if t})
    assert len(files) >= total // (60 + 400)


def test_no_items_and_no_documents(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    [r] = decontaminate.digest(decontaminate.find_hits(docs, none)).collect()
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False)
    assert decontaminate.decontaminate(docs.limit(0), none).collect() == []


def test_texts_are_cut_where_hits_are_found(spark):
    """One Python worker a task finds and cuts: no second function holds a worker of its own."""
    item = "one two three four five six seven eight nine ten"
    long = " ".join(f"w{i}" for i in range(40))
    texts = [(1, f"{long}, {item.upper()}!  {long}"), (2, item), (3, long), (4, None), (5, ""), (6, f"é {long}\n{item}\nß {item} {long}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("left", "hits", "items", "n_words")})
    bench = spark.createDataFrame([(1, item), (2, "w39 é ß w0 w7")], "item_id long, text string")
    want = {1: f"{long}, !  {long}", 3: long, 4: None, 5: "", 6: f"é {long} \nß {long}"}
    for block_words in (5, 1_000_000):
        out = decontaminate.decontaminate(docs, bench, block_words=block_words)
        assert out.columns == docs.columns
        assert {r.doc_id: (r.text, r.left) for r in out.collect()} == {d: (t, "x") for d, t in want.items()}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
