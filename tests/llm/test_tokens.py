"""Token ids of whole texts, their files and their packing against the library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common, dac, packing, registry, tokens

registry.load()

ODD = [
    "Plain words, here.", "it's WE'LL 'quote' ''s 's", "28.68.191.238 +1 (017) 555-7713", "naïve CAFÉ Éque ß ẞ İstanbul ŀ ĳ", "á éx ́", "日本語 テキスト。次", "Ωμέγας ΣΑΣ", "²½¹ ª º ½x",
    "<|endoftext|> a <|startoftext|>b <| x", "x y \u0085z a b", "soft­hyphen", "🙂🙃 ok👍", "_under_score_ a_b", "\x00 \x1c a\x1fb", "w" * 3000, "ab-" * 2000, "é" * 500, " \n\t", "", None, "ǅ ǆ Ǆ ǈ", "Ⅷ ⅷ ①",
    "don't you're I've I'm he'd 'RE", "###$$$!!", "K Å", "ſt ﬁ",
]


def _ids(texts, end):
    library = Tokenizer.from_file(tokens.default_tokenizer())
    return [[*library.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rng = random.Random(6)
    pool = list("abcÉéßİ'.,!?- 0159日́ #_<|") + ["'s", "'LL", " the "]
    made = [*enumerate(ODD), *((100 + i, "".join(rng.choices(pool, k=rng.randint(1, 50)))) for i in range(1500))]
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return made + [(10_000 + r.doc_id, r.text) for r in given]


@pytest.mark.parametrize("remembered", [200_000, 50])
def test_ids_are_the_library_s(rows, monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    encode = tokens.WordEncoder(tokens.default_tokenizer())
    assert encode.model is not None
    texts = [t or "" for _, t in rows]
    got = []
    for i in range(0, len(texts), 40):
        got += encode.encode_all([t.encode() for t in texts[i : i + 40]])
    for text, packed, want in zip(texts, got, _ids(texts, 0), strict=True):
        assert np.frombuffer(packed, encode.dtype).tolist() == want[:-1], text[:80]
    assert max(map(len, encode.known), default=0) <= tokens.LONG_WORD


def test_files_hold_every_document_in_order(spark, rows):
    clash = {c: F.lit("x") for c in ("file", "part", "number", "tokens", "before", "start")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3)
    folder = common.new_folder(spark, "dac")
    back = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in dac.read_dac(dac.write_dac(docs, folder, file_tokens=5000), folder).collect())
    want, start = [], 0
    for (doc_id, _), ids in zip(sorted(rows, key=lambda r: r[0]), _ids([t for _, t in sorted(rows, key=lambda r: r[0])], 1), strict=True):
        want.append((doc_id, start, len(ids), _crc(ids)))
        start += len(ids)
    assert back == want


def _check_packing(pieces, ids, capacity=4096):
    pieces = [p.asDict() for p in pieces]
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            assert p["ids_crc32"] == _crc(ids[doc][at : at + p["length"]])
            at += p["length"]
        assert at == len(ids[doc])
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 0.02 * sum(map(len, ids.values()))


def test_packing_holds_every_token_once(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("start", "offset", "cost")})
    _check_packing(packing.pack(docs.repartition(2)).collect(), dict(zip((d for d, _ in rows), _ids([t for _, t in rows], 2), strict=True)))


def test_queries_over_a_given_table(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    ids = dict(zip((d for d, _ in docs), _ids([t for _, t in docs], 1), strict=True))
    got, start = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in registry.QUERIES["op6_dac"](spark, sf_dir).collect()), 0
    for row, (doc_id, _) in zip(got, docs, strict=True):
        assert row == (doc_id, start, len(ids[doc_id]), _crc(ids[doc_id]))
        start += len(ids[doc_id])
    _check_packing(registry.QUERIES["op8_packing"](spark, sf_dir).collect(), {d: [*x[:-1], 2] for d, x in ids.items()})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = common.new_folder(spark, "dac")
    assert dac.read_dac(dac.write_dac(docs, folder), folder).collect() == [] == packing.pack(docs).collect()


def test_words_of_letters_go_straight_to_the_model():
    encode = tokens.WordEncoder(tokens.default_tokenizer())
    assert encode.model is not None

    class Unused:
        def fullmatch(self, text):
            raise AssertionError(text)

    encode.latin = Unused()
    text = "Plain WORDS of letters plain"
    want = _ids([text], 1)[0][:-1]
    assert np.frombuffer(encode.encode(text.encode()), encode.dtype).tolist() == want


def test_words_that_differ_in_marks_share_their_parts():
    encode = tokens.WordEncoder(tokens.default_tokenizer())
    texts = ["Word word, (word) word.", "word! été; ÉTÉ, word's"]
    got = encode.encode_all([t.encode() for t in texts])
    assert [np.frombuffer(p, encode.dtype).tolist() for p in got] == [i[:-1] for i in _ids(texts, 0)]
    assert set(encode.known) <= {p.encode() for p in ("\n", "word", ",", "(", ")", ".", "!", ";", "été", "'s")}


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_rows_keep_their_ids_whatever_the_slices(rows, monkeypatch, kind):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    rows = [(i, t) for i, t in rows if i < 1100]
    ids = [[*i[:-1], 7] for i in _ids([t for _, t in rows], 0)]
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows], kind)], names=["doc_id", "text"])
    none = batch.slice(0, 0)
    got = list(tokens.encoded_rows(iter([none, batch.slice(0, 10), batch.slice(10), none]), tokens.default_tokenizer(), 7))
    assert [(i, x.tolist()) for i, x in got] == [(i, x) for (i, _), x in zip(rows, ids, strict=True)]


def test_memory_is_given_back_after_every_slice(monkeypatch):
    """Workers idle beside later stages, so what a slice took may not stay with them."""
    given, pool = [], pa.default_memory_pool()

    class Pool:
        def release_unused(self):
            given.append(1)
            pool.release_unused()

    monkeypatch.setattr(tokens, "SLICE_BYTES", 10)
    monkeypatch.setattr(tokens.pa, "default_memory_pool", Pool)
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["word " * 4, "b " * 9, None])], names=["doc_id", "text"])
    found = list(tokens.encoded_rows(iter([batch, batch]), tokens.default_tokenizer(), 1))
    assert [d for d, _ in found] == [1, 2, 3] * 2 and len(given) == 2 * 3
