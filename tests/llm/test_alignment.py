"""The alignment of two tokenizers against whole texts encoded by both libraries."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, tokens

ODD = [
    "a  b", " lead", "trail  ", "\n", "\n\n a\n b\t c \n", "x  y", "x   y z", "A.B, c.d; e...", "it's we'll I'D", "<s> </s> <unk> <0x41> <|endoftext|>",
    "▁ mark", "naïve café ÉCOLE", "日本語 テキスト。次", "é ö", "🙂🙃 👩‍👩‍👧", "1234567 3.14, 1,000.5!", "http://a.b/c?d=e&f", "\x00\x01 \x7f", "﻿bom", "tab\tx\r\ny", "word.\nNext", "end.", "　 wide", "ﬁ ² ½",
    "a" * 5000, "xyz " * 500, "é" * 700 + " " + "-" * 300, "?!.,:;" * 3, "0.5:1.5", " ", "   ", "s's 's", "n't\n'll", "\u0085 \u0085x", "  l  p",
]


def _whole(text, a, b, vocab_a):
    """Token ids and ends of both, or None where they spell other bytes."""
    if not text:
        return None
    full = (" " + text).encode()
    alphabet = tokens.byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    spelt_a = [bytes(alphabet[c] for c in vocab_a[i]) for i in ids_a]
    ids_b = b.encode(text)
    spelt_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if b"".join(spelt_a) != full or b"".join(spelt_b) != full:
        return None
    return ids_a, ids_b, [*accumulate(map(len, spelt_a))], [*accumulate(map(len, spelt_b))]


def _brute(rows):
    path_a, path_b = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    vocab_a = {i: t for t, i in a.get_vocab().items()}
    made, count = [], Counter()
    for doc_id, text in rows:
        found = _whole(text, a, b, vocab_a)
        if found is None:
            made.append((doc_id, 0, 0, 0, [], ""))
            continue
        ids_a, ids_b, ends_a, ends_b = found
        pairs, owner_b = [], [j for j, e in enumerate(ends_b) for _ in range(e - (ends_b[j - 1] if j else 0))]
        for i, e in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            pairs += [(ids_a[i], ids_b[j]) for j in sorted(set(owner_b[start:e]))]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        count.update(set(pairs))
        made.append((doc_id, len(ids_a), len(ids_b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return sorted([(d, na, nb, g, len(p), sum(count[x] == best[x[0]] for x in p), sum(count[x] for x in p), h) for d, na, nb, g, p, h in made], key=str)


def _run(docs, **options):
    out = alignment.align_documents(docs, **options).collect()
    return sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out], key=str)


def test_alignment_of_odd_texts(spark):
    rng = random.Random(4)
    rows = [*enumerate(ODD), (None, "null id"), (7, "again"), (7, "again"), (100, None), (101, "")]
    pool = list("abcÉé'.,!? \n\t0159- 日▁")
    rows += [(200 + i, "".join(rng.choices(pool, k=rng.randint(1, 60)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "a", "b", "held", "i", "n", "of", "best")})
    want = _brute(rows)
    assert _run(docs) == want and sum(r[1] == 0 for r in want) > 2
    # Many small blocks, so that pairs are counted over blocks.
    assert _run(docs.repartition(3), block_bytes=200) == want
    assert _run(docs.where("doc_id >= 100 and doc_id < 102")) == [(100, 0, 0, 0, 0, 0, 0, ""), (101, 0, 0, 0, 0, 0, 0, "")]
    assert _run(docs.where("doc_id = -1")) == []


def test_alignment_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert _run(docs) == _brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_all_common_ends(seed):
    rng = random.Random(seed)
    for n in (1, 2, 3, 10, 200):
        ends_a, ends_b = ({*rng.sample(range(1, 3 * n + 1), rng.randint(1, 2 * n)), 3 * n + 1} for _ in range(2))
        found = alignment.cuts(sorted(ends_a), sorted(ends_b))
        common = sorted(ends_a & ends_b)
        assert found == [(sorted(ends_a).index(e) + 1, sorted(ends_b).index(e) + 1) for e in common]


def test_a_block_is_many_small_rows(spark, monkeypatch):
    """Row sizes bound what the JVM and a worker hold at a time, whatever a block holds."""
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 30_000)
    monkeypatch.setattr(alignment, "ROW_PAIRS", 200, raising=False)
    made = alignment.block_table(docs, alignment.default_tokenizers()).collect()
    assert len({r.block for r in made}) == 1
    assert max(len(r.a) for r in made) <= 200 < sum(len(r.a) for r in made) and max(len(r.doc_id) for r in made) <= 100
    assert sorted(d for r in made for d in r.doc_id) == list(range(300))
    assert len({(a, b) for r in made for a, b in zip(r.a, r.b, strict=True)}) == sum(len(r.a) for r in made)
    assert _run(docs) == _brute(rows)
