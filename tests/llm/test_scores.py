"""Counts, base score and lattice score of whole tables against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import lattice, registry

registry.load()


def _tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def _base(rows):
    held = [zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    count = Counter(t for (_, text), h in zip(rows, held, strict=True) if not h for t in _tokens(text))
    n, v = sum(count.values()), len(count)
    out = {}
    for (d, text), h in zip(rows, held, strict=True):
        found = _tokens(text)
        out[d] = (h, len(found), sum(count[t] > 0 for t in found), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in found))
    return out


def _check(out, rows):
    want = _base(rows)
    assert len(out) == len(want)
    for r in out:
        held, tokens, known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)


def test_query_over_a_given_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = registry.QUERIES["op3_lattice"](spark, sf_dir).collect()
    _check(out, rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def _model(rows, vocabulary):
    """Piece probabilities after one pass of expected counts, all segmentations being enumerated."""
    v = lattice.Vocabulary(vocabulary)

    def ways(word):
        """(pieces, log weight) of every segmentation."""
        if word == "":
            return [((v.end,), 0.0)]
        found, text = [], "▁" + word
        longest = max(map(len, v.pieces))

        def go(at, used):
            if at == len(text):
                found.append(tuple(used))
                return
            for end in range(at + 1, min(len(text), at + longest) + 1):
                piece = text[at:end]
                if piece in v.pieces:
                    go(end, [*used, v.pieces[piece]])
                elif end == at + 1:
                    go(end, [*used, *(v.bytes[b] for b in piece.encode())])

        go(0, [])
        return found

    def weights(word, p):
        return [(w if isinstance(w[0], int) else w[0], sum(math.log(p[i]) for i in (w if isinstance(w[0], int) else w[0]))) for w in ways(word)]

    p = v.prior.tolist()
    counts = [lattice.PRIOR_PIECES * x for x in p]
    train = Counter(t for d, text in rows if zlib.crc32(str(d).encode()) % 5 != 1 for t in _tokens(text))
    for word, n in train.items():
        each = weights(word, p)
        total = sum(math.exp(x) for _, x in each)
        for used, x in each:
            for i in used:
                counts[i] += n * math.exp(x) / total
    whole = sum(counts)
    p = [c / whole for c in counts]
    return {d: sum(math.log10(sum(math.exp(x) for _, x in weights(t, p))) for t in _tokens(text)) for d, text in rows}


def test_scores_are_sums_over_all_segmentations(spark):
    rng = random.Random(4)
    pool = ["the", "then", "Other", "ab", "né", "日本", "x1", "ing", "", "a" * 6]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 8)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "words", "word", "c", "i")})
    out = lattice.score_documents(docs, block_bytes=300).collect()
    _check(out, rows)
    want = _model(rows, lattice.default_vocabulary())
    for r in out:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-6), r.doc_id


def test_empty_table(spark):
    assert lattice.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_block_is_many_small_rows(spark):
    """Row sizes bound what the JVM and a worker hold at a time, whatever a block holds."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(100))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made = lattice.block_table(docs).collect()
    assert len({r.block for r in made}) == 1
    assert max(len(r.words) for r in made) <= 5_000 and max(sum(r.sizes) for r in made) <= 25_000 + 101
    assert sorted(d for r in made for d in r.doc_id) == list(range(300))
    assert len({w for r in made for w in r.words}) == sum(len(r.words) for r in made) == 30_001
    _check(lattice.score_documents(docs).collect(), rows)
