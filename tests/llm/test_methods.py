"""The parts that need no Spark, against brute force."""

import io
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import dac, decontaminate, lattice, near_dedup, packing, secrets, tokens, url_rules, warc


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, count, place):
        return self.data[place : place + count]


def test_dac_round_trip_and_random_access():
    rng = random.Random(3)
    for docs in ([], [[1]], [[rng.choice([3, 300, 70_000, 1 << 31]) for _ in range(rng.randint(1, 900))] for _ in range(7)]):
        arrays = [np.array(d, np.uint32) for d in docs]
        ids = [None, *range(len(docs) - 1)] if docs else []
        f = dac.DacFile(Bytes(dac.file_bytes(ids, arrays)))
        flat = [t for d in docs for t in d]
        assert f.documents() == ids
        assert f.tokens(0, len(flat)).tolist() == flat
        for i in rng.sample(range(len(flat)), min(50, len(flat))):
            assert f.token(i) == flat[i]
            j = min(len(flat), i + rng.randint(0, 700))
            assert f.tokens(i, j).tolist() == flat[i:j]


def test_packing_is_exact():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.choice([1, 3, 7, 16, 17, 40, 100]) for _ in range(rng.randint(1, 60))]
        pieces = packing.balance(lengths, 16, 1.0, 0.1)
        by_doc = {d: sorted((s, n) for e, s, n, _, _ in pieces if e == d) for d in range(len(lengths))}
        for d, parts in by_doc.items():
            assert sum(n for _, n in parts) == lengths[d]
            assert [s for s, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
        sizes = packing.capacities(sum(lengths), 16)
        for k, size in enumerate(sizes):
            own = sorted((o, n) for _, _, n, s, o in pieces if s == k)
            assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
            assert sum(n for _, n in own) == size and (size == 16 or size & (size - 1) == 0)


def test_longest_document_goes_to_the_cheapest_sequence():
    assert packing.balance([8, 8, 4, 4, 4, 4], 16, 1.0, 1.0)[:3] == [(0, 0, 8, 0, 0), (1, 0, 8, 1, 0), (2, 0, 4, 0, 8)]


def test_encoder_matches_the_library():
    encode = tokens.WordEncoder(tokens.default_tokenizer())
    texts = ["", " ", "It's A Test. don't", "Ünïcode ß İ é x", "a<|endoftext|>b", "x" * 500 + " y.", "1.5, 22!?", "\x1ca\x1db  c", "😀😀 ok."]
    for text in [*texts, *texts]:
        assert np.frombuffer(encode.encode(text.encode()), encode.dtype).tolist() == encode._ids(text), text


def test_zip_directory_with_and_without_zip64():
    for always in (False, True):
        sink = io.BytesIO()
        z = warc.ZipWriter(sink, always)
        for name, data in (("a", b"one"), ("b/c", b"")):
            z.begin(name)
            z.add(data)
            z.end()
        z.close()
        data = sink.getvalue()
        found = warc.zip_members(lambda p, n: data[p : p + n], len(data))
        assert {n: data[p : p + s] for n, (p, s) in found.items()} == {"a": b"one", "b/c": b""}
        import zipfile

        with zipfile.ZipFile(io.BytesIO(data)) as known:
            assert known.testzip() is None and known.read("a") == b"one"


def test_automaton_against_windows():
    rng = random.Random(5)
    for _ in range(60):
        items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))]) for i in range(5)]
        doc = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        hits, names = set(), set()
        for name, words in items:
            n = min(4, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                for p in range(len(doc) - n + 1):
                    if doc[p : p + n] == words[i : i + n]:
                        hits |= set(range(p, p + n))
                        names.add(name)
        spans, found = decontaminate.Automaton(items, 4).search(doc)
        assert {i for a, b in spans for i in range(a, b)} == hits and found == names


def test_cut_words():
    assert decontaminate.cut_words("One, two THREE four.", [[1, 3]]) == "One, four."
    assert decontaminate.cut_words("é one", [[0, 2]]) == ""


def test_globs_against_expressions():
    rng = random.Random(2)
    globs = ["a*b", "**a", "*/b?", "?b**", "", "*", "**/a/**", "ab" * 40]
    regexes = [re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", g)), re.S) for g in globs]
    urls = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["ab" * 40, "é/a/"]
    got = url_rules.GlobAutomaton(globs).match([u.encode() for u in urls])
    for u, row in zip(urls, got, strict=True):
        assert row.tolist() == [bool(r.fullmatch(u)) for r in regexes], u


def test_lattice_against_enumeration():
    v = lattice.Vocabulary(lattice.default_vocabulary())
    model = lattice.Lattice(v, v.prior)

    def total(word):
        if not word:
            return 1.0
        out = sum(v.prior[v.pieces[word[:j]]] * total(word[j:]) for j in range(1, len(word) + 1) if word[:j] in v.pieces)
        if word[0] not in v.pieces:
            out += math.prod(v.prior[v.bytes[b]] for b in word[0].encode()) * total(word[1:])
        return out

    for word in ("the", "shores", "ñandú", "x\U0001F600y"):
        assert math.isclose(model.score(word.encode()), math.log(total("▁" + word)), rel_tol=1e-9)
    counts = [0.0] * len(v.prior)
    model.expect("shores".encode(), 2.0, counts)
    spelt = {i: p for p, i in v.pieces.items()}
    covered = sum(c * (len(spelt[i].encode()) if i in spelt else 1) for i, c in enumerate(counts) if c)
    assert math.isclose(covered, 2 * len("▁shores".encode()), rel_tol=1e-9)
    assert model.score(("z" * 20_000).encode()) < -1000


def test_secret_base_spans_and_grammar():
    text = 'Password = "abc" token=api_key:abcdefgh1 SECRET: "abcdefgh" AKIA1234567890AB AKIAXY ' + "0f" * 16 + " ſecret=abcdefgh"
    spans, values = secrets.base_spans(text)
    assert [(secrets.KINDS[k], v) for (_, k, _), v in zip(spans, values, strict=True)] == [
        ("assign", "abcdefgh"), ("access", "AKIA1234567890AB"), ("hex", "0f" * 16)
    ]
    rng = random.Random(4)
    key = lambda n: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(400)]
    plain = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(12, 18))) + str(rng.randint(1, 9)) for _ in range(400)]
    formats = secrets.Formats({"access": [key(16) for _ in range(400)], "hex": hexes}, plain)
    fresh = ["".join(rng.choice("0123456789abcdef") for _ in range(30)) for _ in range(50)]
    other = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(12, 18))) + str(rng.randint(1, 9)) for _ in range(50)]
    assert sum(formats.score(t) >= 0 for t in fresh) >= 40
    assert sum(formats.score(t) >= 0 for t in other) == 0


def test_short_bare_secrets_are_scored():
    rng = random.Random(13)
    key = lambda: "".join(rng.choice("bcdfghjkmnpqrstvwxz23456789") for _ in range(12))
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 10))) for _ in range(400)]
    mixed = [w + str(rng.randint(1, 99)) for w in words if len(w) < 5]
    formats = secrets.Formats({"assign": [key() for _ in range(400)]}, words + mixed)
    bare = [k for k in (key() for _ in range(200)) if any(c.isdigit() for c in k) and any(c.isalpha() for c in k)]
    other = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(7, 12))) + str(rng.randint(1, 99)) for _ in range(200)]
    found = lambda tokens: sum(formats.score(t) >= 0 for _, _, t in secrets.candidates(" ".join(tokens), []))
    assert found(bare) >= 0.9 * len(bare) and found(other) == 0


def test_signatures_and_parity_bound():
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    a = near_dedup.shingle_set(" ".join(base).encode(), 3)
    words = list(base)
    for i in rng.sample(range(300), 4):
        words[i] = "new"
    b = near_dedup.shingle_set(" ".join(words).encode(), 3)
    sig = near_dedup.signature([a, b, near_dedup.shingle_set(b"one", 3)])
    jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - jaccard) < 0.15
    assert (near_dedup.band_keys(sig)[0] == near_dedup.band_keys(sig)[1]).any()
    apart = np.unpackbits((near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint8)).sum()
    assert apart <= len(np.setxor1d(a, b))


def test_slices_keep_all_rows(monkeypatch):
    monkeypatch.setattr(near_dedup, "SLICE_BYTES", 100)
    texts = ["a b", None, "", "c " * 90, "d e f g"] * 30
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    cut = list(near_dedup.slices(iter([batch.slice(3), batch.slice(0, 0), batch.slice(0, 3)]), 3))
    assert [i for ids, _ in cut for i in ids.to_pylist()] == [*range(3, len(texts)), *range(3)]
    assert all(sum(len(texts[i] or "") for i in ids.to_pylist()) <= 100 or len(ids) == 1 for ids, _ in cut)
    assert [len(s) for _, sets in cut for s in sets] == [len(near_dedup.shingle_set((t or "").encode(), 3)) for t in texts[3:] + texts[:3]]
