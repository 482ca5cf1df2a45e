"""Personal data: the base spans against plain patterns, the method against planted spans."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import pii, registry

registry.load()

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "a@b.c@d.e", "@@a@b..c x@y.z.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.2.3.0004 000000000000000000000001.2.3.4", "4111 1111 1111 1111-", "4111-1111-1111-1111 1",
    "+1 (017) 555-7713.", "++49 30 123456789", "+1 2", "1.2.3.4@5.6", "é+33 1 23 45 67 89é", "a.b@c.d 4111111111111111", "" , None, "...@...", "a@b", "1..2.3.4.5",
]


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_base_spans_against_plain_patterns(spark, sf_dir):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("0123456789+-. ()@ab", k=rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert [(pii.KINDS[k], a, b) for a, k, b in pii.base_spans(text or "")] == _base(text), text
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = registry.QUERIES["op12_personal"](spark, sf_dir).collect()
    assert len(out) == len(docs)
    for r in out:
        base = _base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in PATTERNS]
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) - {""} <= set(r.spans.split(","))


def test_long_runs_take_time_in_proportion():
    """Patterns tried at every place of a run would take hours here."""
    for run in ("a" * 2_000_000, "1" * 2_000_000, "@" * 500_000, "1." * 500_000, "+1 " * 300_000, "a@" * 300_000):
        base = pii.base_spans(run)
        pii.loose_spans(run, base)


def _luhn(rng, prefix, n):
    body = prefix + "".join(rng.choices("0123456789", k=n - len(prefix) - 1))
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


def test_method_adds_personal_spans_and_leaves_others(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(rng.choices("23456789", k=n))
    wanted, others, rows = set(), set(), []
    for i in range(400):
        yes = [
            f"{word()}.{word()} [at] {word()} [dot] com", f"({rng.randint(200, 989)}) {digits(3)}-{digits(4)}", f"2001:db8:{digits(4)}::{digits(3)}", _luhn(rng, "4", 13),
        ]
        plain = _luhn(rng, "9", 16)
        no = [plain[:-1] + str((int(plain[-1]) + 3) % 10), f"{digits(4)}.{digits(5)}", f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}"]
        base = [f"{word()}@{word()}.com", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{rng.randint(30, 200)}.51.17.{rng.randint(1, 255)}", _luhn(rng, "4", 16)]
        cues = ["mail", "tel", "host", "card"]
        parts = [p for k in range(4) for p in (some(3), f"{cues[k]} {yes[k]}", some(3), base[k])] + [p for n in no for p in (f"{some(2)} order no {n}", some(3))]
        wanted.update(yes)
        others.update(no)
        rows.append((i, " ".join(parts)))
    clash = {c: F.lit(1) for c in ("start", "end", "kind", "base", "code", "spans")}
    out = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)).collect()
    found = {rows[r.doc_id][1][s.start : s.end] for r in out for s in r.spans if not s.base}
    assert len(found & wanted) >= 0.95 * len(wanted)
    assert not found & others


def test_reliabilities_are_estimated():
    """Labelers with known error rates: the estimate finds the good one and the useless one."""
    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.3
    votes = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 for r in (0.95, 0.9, 0.8, 0.75, 0.5)], axis=1)
    chance, shares = pii.estimate(votes, np.ones(len(votes)))
    assert ((chance > 0.5) == truth).mean() > 0.95
    right = [(shares[1][j][2] + shares[0][j][0]) / 2 for j in range(5)]
    assert np.allclose(right, (0.95, 0.9, 0.8, 0.75, 0.5), atol=0.03)


def test_small_inputs(spark):
    schema = "doc_id long, text string"
    assert pii.find_personal(spark.createDataFrame([], schema)).collect() == []
    rows = pii.find_personal(spark.createDataFrame([(1, None), (None, ""), (2, "a@b.co"), (2, "a@b.co")], schema)).collect()
    assert sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in rows) == [(0, []), (1, []), (2, [("email", 0, 6)]), (2, [("email", 0, 6)])]
