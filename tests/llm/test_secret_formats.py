"""What the inferred formats take for secrets, and the base spans of whole tables."""

import hashlib
import os
import random
import re
import string

import pytest

from tidemark.llm import registry, secrets

registry.load()

EVERYDAY = (
    "windows10pro iPhone15ProMax Isaiah53verse5 192x168x1x100 1234567890a GPT4turbo2024 covid-19-vaccine rev2-final-v3 2024-01-15T10 IMG_20240115_1234"
    " chapter12section4 version-2-10-beta sha256sum utf-8-encoding H2O2molecule python3-11-dev Room101Door5 4x4drive2wheel top10lists2023 mp3player-64gb"
).split()
_LOW, _ALL = string.ascii_lowercase + string.digits, string.ascii_letters + string.digits


def _words(rng, n):
    """Words of syllables, with a capital now and then."""
    syllables = [c + v for c in "bcdfghlmnprstvw" for v in "aeiou"] + ["th", "st", "er", "on", "an", "ing", "tion"]
    return [w.capitalize() if rng.random() < 0.1 else w for w in ("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))]


@pytest.mark.parametrize(("prefix", "letters", "size"), [("", _ALL, 32), ("sk_", _LOW, 24), ("", "0123456789abcdef", 28), ("ghp_", _ALL, 20), ("", _ALL + "+/", 40)])
def test_keys_are_found_and_everyday_tokens_are_not(prefix, letters, size):
    rng = random.Random(size)
    key = lambda: prefix + "".join(rng.choices(letters, k=size))
    words = _words(rng, 2000)
    slugs = ["-".join([*rng.sample(words, 3), str(rng.randint(1, 2000))]) for _ in range(300)]
    formats = secrets.Formats({"assign": [key() for _ in range(60)]}, words)
    assert not [t for t in EVERYDAY + slugs if formats.score(t) >= 0]
    assert sum(formats.score(key()) >= 0 for _ in range(400)) >= 0.95 * 400


def test_a_symbol_that_a_state_never_saw_leaves_it():
    """A token that enters a seldom seen state by chance doesn't pay for it up to its end."""
    rng = random.Random(9)
    grammar = secrets.Grammar(["".join(rng.choices(_LOW, k=24)) for _ in range(60)])
    assert all(grammar.score("".join(rng.choices(_LOW, k=24))) > secrets.UNIFORM for _ in range(500))
    # What no labelled value holds is far less likely than a uniform guess.
    assert grammar.score("ABCDEFGH") < secrets.UNIFORM


def test_bare_keys_among_slugs_depend_on_the_method(spark):
    rng = random.Random(13)
    words, key = _words(rng, 3000), lambda: "".join(rng.choices(_ALL, k=32))
    rows, bare = [], set()
    for i in range(200):
        own = key()
        bare.add(own)
        parts = [*rng.sample(words, 20), f'token = "{key()}"', *rng.sample(words, 5), own, rng.choice(EVERYDAY), "-".join([*rng.sample(words, 3), str(i)]), *rng.sample(words, 5)]
        rows.append((i, " ".join(parts)))
    texts = dict(rows)
    out = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {texts[r.doc_id][s.start : s.end] for r in out for s in r.spans if s.kind == "format"}
    assert len(found & bare) >= 0.95 * len(bare) and not found - bare


PATTERNS = {"assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), "access": (r"(AKIA[A-Z0-9]+)", 16), "hex": (r"([0-9a-f]+)", 32)}


def test_base_columns_against_plain_patterns(spark):
    sf_dir = os.environ.get("TEST_SECRETS_DIR", "/root/testdata/sf0.01")  # the smallest table holds none
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = registry.QUERIES["op2_secrets"](spark, sf_dir).collect()
    assert len(out) == len(docs) and sum(r.n_assign for r in out) > 0
    for r in out:
        base = sorted((m.start(), k, kind, m.end()) for k, (kind, (p, least)) in enumerate(PATTERNS.items()) for m in re.finditer(p, docs[r.doc_id], re.ASCII) if len(m.groups()[-1]) >= least)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[2] == k for b in base) for k in PATTERNS]
        joined = [f"{kind}:{a}:{b}" for a, _, kind, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert {*joined} <= {*r.spans.split(",")} or not joined
