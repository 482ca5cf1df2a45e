"""The Merkle manifest against a plain construction in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    values = (r[0], r[3], r[2], r[4], text)
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _proofs(nodes):
    """Root of the nodes, and of each its (place, others) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, path in enumerate(paths):
            first = at[j] // 8 * 8
            path.append((at[j] - first, [n for k, n in enumerate(nodes[first : first + 8]) if k != at[j] - first]))
        nodes = [_h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [a // 8 for a in at]
    return nodes[0], paths


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    found = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        found[lang] = _proofs([_leaf(r, r[1]) for r in trees[lang]])
    root, tops = _proofs([found[k][0] for k in order])
    out = []
    for lang, top in zip(order, tops, strict=True):
        subroot, paths = found[lang]
        for r, path in zip(trees[lang], paths, strict=True):
            claim = r[1]
            if r[0] is not None and claim is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                claim = _lower(claim)
            node = _leaf(r, claim)
            for place, others in path + top:
                node = _h(*others[:place], node, *others[place:])
            out.append((r[0], _leaf(r, r[1]), subroot, root, _h(*(o for _, others in path + top for o in others)), node, node == root))
    return sorted(out, key=str)


def _run(docs):
    out = merkle.manifest(docs, merkle.tampered(F.col("doc_id"), F.col("text")))
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()], key=str)


def _rows(n, langs):
    rng = random.Random(n)
    rows = [(i * 7, rng.choice(["Abc é", "plain", "", None, "ÉX"]) and f"T{i} {rng.random()}"[: rng.randint(0, 12)], rng.choice(langs), rng.choice(["a", None]), rng.choice([i, None])) for i in range(n)]
    odd = [(None, "A", None, None, None), (None, "A", None, None, None), (-5, None, "", "", 0), (2**62, "Z" * 100_000, "de", "a", 1), (2**62, "Z", "de", "a", 1), (3, "one", "zz", None, 3)]
    rows += odd
    rng.shuffle(rows)
    return rows


def test_manifest_against_brute_force(spark):
    rows = _rows(4700, ["en"] * 30 + ["de"])
    # Columns named like the operator's own are ignored.
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "i", "n", "node", "claimed", "block", "_tie", "_part", "key", "leaf", "root")})
    assert _run(docs.repartition(5)) == _brute(rows)


@pytest.mark.parametrize("n", [1, 8, 9, 300])
def test_manifest_over_many_rounds(spark, monkeypatch, n):
    """Superblocks of one level, so that paths are handed down several times."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = _rows(n, ["en", "de", None, "é", "E", "e", "f", "g", "h", "i"])
    assert _run(spark.createDataFrame(rows, SCHEMA)) == _brute(rows)


def test_manifest_of_one_row_and_of_none(spark):
    row = [(1, "x", "en", "a", 1)]
    [r] = _run(spark.createDataFrame(row, SCHEMA))
    assert r == (1, _leaf(row[0], "x"), r[1], r[1], _h(""), r[1], True)
    assert _run(spark.createDataFrame([], SCHEMA)) == []
