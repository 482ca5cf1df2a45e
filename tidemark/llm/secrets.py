"""Secrets by fixed patterns and by the inferred grammars of known credentials.

Three patterns give the base spans. Their values are the labelled credentials: of each kind a
bounded sample (the ``SAMPLE`` distinct values of the smallest hash) becomes a prefix tree with
counts, whose states are merged where the frequencies of their next symbols, and those of
all that follows, agree within Hoeffding's bound. The result is a probabilistic automaton a
kind, and one more for the words of ordinary tokens. Every token with letters and digits
outside the base spans, as long as the shortest labelled value, is a candidate; it is added as ``format`` where some kind's
automaton gives it a likelihood per symbol that nearly all labelled values of the kind reach
and a uniform guess doesn't exceed (but for a little), and clearly more than its likelihood as an ordinary token.

States back off to the automaton's symbols and those to a uniform guess; a symbol that a state
never saw leads to where it leads from the start, so no token stays in a state it doesn't fit.

Ordinary tokens are those that are no candidates (plain words, numbers, short mixed tokens)
outside the base spans, so a format is never taken for ordinary because it is common. A mixed
token is ordinary as a chain of parts: words, in one of three spellings, and numbers, joined
by a mark or a change of kind. Its words have the likelihood of the words' automaton (seldom any letters), so names,
slugs and versions are ordinary however seldom their chain occurs, while a random key, whose
runs are short and unlike words, is not.

Texts are read once, by plain regular expressions on whole texts; what is found is written
and learned from, so neither texts nor candidates meet in one place. Of the ordinary tokens a
task hands on those of the smallest digests, which hold the smallest of all.

Defined results: a null or empty text has no span; offsets are code points, the end
exclusive, over the whole match; equal rows get equal results; without labelled values
nothing is added; without ordinary tokens words are as likely as any letters; an empty table
gives none; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import carry, read_table
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

# The base patterns and the least length of their value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "format")
_KEYWORDS = ("passw", "secret", "token", "api")

#: Tokens that are scored: as long as the shortest labelled value, with a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min(LEAST_ASSIGN, LEAST_ACCESS))
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_MIXED = re.compile(r"(?=[^0-9]*[0-9])[^A-Za-z]*[A-Za-z]")

#: Labelled values of a kind, and ordinary tokens (no candidates), that automata are inferred from.
SAMPLE = 2000
#: Significance of the test that keeps two states apart.
ALPHA = 0.05
#: Weight of a state's back-off to the automaton's symbols, and of those to a uniform guess.
BACK_OFF, UNSEEN = 10.0, 1.0
SYMBOLS = 68
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Natural log of the likelihood per symbol of a uniform guess.
UNIFORM = -math.log(SYMBOLS + 1)
#: Share of the labelled values of a kind that may score below its limit.
MISSED = 0.02
#: Natural log of the likelihood per symbol that a kind's limit gives way, as lengths differ.
SLACK = 0.1
#: Natural log of the likelihood ratio per symbol over ordinary tokens.
MARGIN = 0.25
#: Natural log of the odds against a mixed token being a secret, which its whole likelihood ratio has to beat.
ODDS = 13.0

#: Parts of an ordinary token: the marks between (among them an x for "times"), words in capitals,
#: other words, and numbers.
_PART = re.compile(r"(?P<mark>[+/_=-]|(?<=[0-9])[xX](?=[0-9]))|(?P<word>[A-Z]+(?![a-z])|[A-Z]?[a-z]+)|(?P<number>[0-9]+)")
#: Chances that an ordinary token goes on after a part, that this is at a mark, that a number or a
#: new word goes on, and that a word is new: of any letters, unlike those the automaton was inferred from.
GOES_ON, AT_MARK, LONGER, NEW_WORD = 0.25, 0.5, 0.8, 0.1
_MARKS = 6


class Grammar:
    """Probabilistic automaton inferred from strings by merging states of their prefix tree."""

    def __init__(self, strings: Iterable[str], alpha: float = ALPHA) -> None:
        self.seen, self.ended = [0], [0]
        self.to: list[dict[str, int]] = [{}]
        self.uses: list[dict[str, int]] = [{}]
        for s in strings:
            state = 0
            self.seen[0] += 1
            for c in s:
                after = self.to[state].get(c)
                if after is None:
                    after = self.to[state][c] = len(self.to)
                    self.seen.append(0)
                    self.ended.append(0)
                    self.to.append({})
                    self.uses.append({})
                self.uses[state][c] = self.uses[state].get(c, 0) + 1
                state = after
                self.seen[state] += 1
            self.ended[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self.settle()

    def _merge_all(self) -> None:
        settled, front = [0], [(0, c) for c in sorted(self.to[0])]
        while front:
            # The state seen most often is decided on first.
            front.sort(key=lambda e: (-self.seen[self.to[e[0]][e[1]]], e))
            parent, symbol = front.pop(0)
            state = self.to[parent][symbol]
            same = next((s for s in settled if self._compatible(s, state)), None)
            if same is None:
                settled.append(state)
                front += [(state, c) for c in sorted(self.to[state])]
                continue
            self.to[parent][symbol] = same
            self._fold(same, state)
            known = set(settled)
            front = [(s, c) for s in settled for c in sorted(self.to[s]) if self.to[s][c] not in known]

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, left: int, right: int) -> bool:
        todo = [(left, right)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if self._differ(self.ended[a], n, self.ended[b], m):
                return False
            for c in self.uses[a].keys() | self.uses[b].keys():
                if self._differ(self.uses[a].get(c, 0), n, self.uses[b].get(c, 0), m):
                    return False
                if c in self.to[a] and c in self.to[b]:
                    todo.append((self.to[a][c], self.to[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ended[a] += self.ended[b]
            for c, n in self.uses[b].items():
                self.uses[a][c] = self.uses[a].get(c, 0) + n
                if c in self.to[a]:
                    todo.append((self.to[a][c], self.to[b][c]))
                else:
                    self.to[a][c] = self.to[b][c]

    def settle(self) -> None:
        """Chances of symbols whatever the state, which states back off to."""
        count: dict[str, float] = {}
        ends = 0
        todo, found = [0], {0}
        while todo:
            state = todo.pop()
            ends += self.ended[state]
            for c, after in self.to[state].items():
                count[c] = count.get(c, 0) + self.uses[state][c]
                if after not in found:
                    found.add(after)
                    todo.append(after)
        total = sum(count.values()) + ends + UNSEEN
        self.rare = UNSEEN / (SYMBOLS + 1) / total
        self.symbol = {c: n / total + self.rare for c, n in count.items()}
        self.end = ends / total + self.rare

    def log(self, s: str) -> float:
        """Natural log of the likelihood of a string and its end."""
        state, total = 0, 0.0
        for c in s:
            n = self.uses[state].get(c, 0)
            total += math.log((n + BACK_OFF * self.symbol.get(c, self.rare)) / (self.seen[state] + BACK_OFF))
            state = self.to[state][c] if n else self.to[0].get(c, 0)
        return total + math.log((self.ended[state] + BACK_OFF * self.end) / (self.seen[state] + BACK_OFF))

    def score(self, s: str) -> float:
        """Natural log of the likelihood per symbol, the end being one."""
        return self.log(s) / (len(s) + 1)


class Ordinary:
    """Likelihood of tokens as chains of words and numbers."""

    def __init__(self, tokens: Iterable[str]) -> None:
        words = sorted({m["word"].lower() for t in tokens for m in _PART.finditer(t) if m["word"]})
        self.words = Grammar(words) if words else None
        # Letters of a new word are half as in the known ones, half any.
        known = self.words.symbol if self.words else {}
        self.letters = {c: math.log(LONGER * (0.5 * n + 0.5 / 26)) for c, n in known.items()}
        self.rare = math.log(LONGER * 0.5 / 26)
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        """One of three spellings of a word: small, with a capital, in capitals."""
        if word not in self.known:
            low = word.lower()
            log = math.log(NEW_WORD * (1 - LONGER) / LONGER) + sum([self.letters.get(c, self.rare) for c in low])
            if self.words:
                known = math.log(1 - NEW_WORD) + self.words.log(low)
                log = max(log, known) + math.log1p(math.exp(-abs(log - known)))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = log - math.log(3)
        return self.known[word]

    def score(self, token: str) -> float:
        """Natural log of the likelihood per symbol, the end being one."""
        total, joined = 0.0, True
        for m in _PART.finditer(token):
            if m["mark"]:
                total += math.log(GOES_ON * AT_MARK / _MARKS)
                joined = True
                continue
            if not joined:
                total += math.log(GOES_ON * (1 - AT_MARK))
            total += math.log(0.5)
            if m["word"]:
                total += self.word(m["word"])
            else:
                total += math.log((1 - LONGER) / LONGER) + len(m["number"]) * math.log(LONGER / 10)
            joined = False
        return (total + math.log(1 - GOES_ON)) / (len(token) + 1)


class Formats:
    """Automata of the kinds, their limits, and what ordinary tokens are made of."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]) -> None:
        self.kinds = []
        for _, values in sorted(labelled.items()):
            # Half of the values for the automaton, the others for its limit.
            grammar = Grammar(values[::2])
            scores = sorted(grammar.score(v) for v in values[1::2] or values)
            self.kinds.append((grammar, max(scores[int(MISSED * len(scores))], UNIFORM) - SLACK))
        self.ordinary = Ordinary(ordinary)

    def score(self, token: str) -> float:
        """How far the best kind's likelihood is above its limit and that of an ordinary token."""
        plain = self.ordinary.score(token) + MARGIN + ODDS / (len(token) + 1)
        return max((min(s - limit, s - plain) for s, limit in ((g.score(token), limit) for g, limit in self.kinds)), default=-math.inf)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
    """(start, kind, end) of the base spans in order, and their values."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    found.sort(key=lambda f: f[:2])
    return [f[:3] for f in found], [f[3] for f in found]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Mixed tokens of at least a labelled value's length that touch no base span."""
    out, k, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        if not _MIXED.match(m[0]):
            continue
        while k < len(spans) and spans[k][0] < m.end():
            reach, k = max(reach, spans[k][2]), k + 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def ordinary(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """Distinct tokens that are no candidates and touch no base span."""
    if spans:
        # Spans become spaces, together with what they cut off.
        parts, at = [], 0
        for start, _, end in spans:
            if end > at:
                parts += [text[at:start].rstrip(_SYMBOLS), " "]
                rest = _TOKEN.match(text, end)
                at = rest.end() if rest else end
        text = "".join([*parts, text[at:]])
    return {t for t in set(_TOKEN.findall(text)) if t.isalpha() or not (CANDIDATE.fullmatch(t) and _MIXED.match(t))}


class Smallest:
    """The ``size`` tokens of the smallest digests among those seen so far."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.kept: dict[str, str] = {}
        self.limit = "g"

    def add(self, tokens: Iterable[str]) -> list[str]:
        """Those of the tokens that came to be kept."""
        digests = {t: hashlib.md5(t.encode(), usedforsecurity=False).hexdigest() for t in tokens if t not in self.kept}
        new = {t: d for t, d in digests.items() if d < self.limit}
        self.kept = dict(sorted((self.kept | new).items(), key=lambda e: e[1])[: self.size])
        if len(self.kept) == self.size:
            self.limit = max(self.kept.values())
        return [t for t in new if t in self.kept]


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row its base spans with values, and its candidates; ``plain`` are ordinary tokens of a task."""
    fields = [
        ("doc_id", pa.int64()), ("start", pa.list_(pa.int64())), ("kind", pa.list_(pa.int32())), ("end", pa.list_(pa.int64())),
        ("value", pa.list_(pa.string())), ("c_start", pa.list_(pa.int64())), ("c_end", pa.list_(pa.int64())), ("token", pa.list_(pa.string())),
        ("plain", pa.list_(pa.string())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest = Smallest(sample)
        for batch in batches:
            columns: list[list] = [[] for _ in fields[1:]]
            plain: set[str] = set()
            handed: list[str] = []
            for text in batch[1].to_pylist():
                spans, values = base_spans(text or "")
                tokens = candidates(text or "", spans)
                plain |= ordinary(text or "", spans)
                if len(plain) >= 10 * sample:
                    handed += smallest.add(plain)
                    plain = set()
                row = ([s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], values, [t[0] for t in tokens], [t[1] for t in tokens], [t[2] for t in tokens], [])
                for column, cell in zip(columns, row, strict=True):
                    column.append(cell)
            if batch.num_rows:
                columns[-1][0] = handed + smallest.add(plain)
            arrays = [batch[0], *[pa.array(c, t) for c, (_, t) in zip(columns, fields[1:], strict=True)]]
            yield pa.record_batch(arrays, names=[n for n, _ in fields])

    schema = "doc_id long, start array<long>, kind array<int>, end array<long>, value array<string>, c_start array<long>, c_end array<long>, token array<string>, plain array<string>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def infer(found: DataFrame, sample: int = SAMPLE) -> Formats:
    """Automata from a bounded sample, the same for the same values in any order."""
    labelled = found.select(F.explode(F.arrays_zip("kind", "value")).alias("x")).select(F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).distinct()
    order = [F.xxhash64("value"), F.col("value")]
    values = {KINDS[k]: [r.value for r in labelled.where(F.col("kind") == k).orderBy(*order).limit(sample).collect()] for k in range(3)}
    plain = found.select(F.explode("plain").alias("value")).distinct().orderBy(F.md5("value"), "value").limit(sample).collect()
    return Formats({k: v for k, v in values.items() if v}, [r.value for r in plain])


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row ``doc_id`` and its spans (``kind``, ``start``, ``end``, ``score``) in order."""
    found = cut_lineage(scan(docs, sample))
    shared = carry(docs.sparkSession, infer(found, sample), "formats")
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = shared()
        for batch in batches:
            out = []
            for start, kind, end, c_start, c_end, tokens in zip(*(batch[n].to_pylist() for n in ("start", "kind", "end", "c_start", "c_end", "token")), strict=True):
                spans = list(zip(start, kind, end, [None] * len(start), strict=True))
                for a, b, token in zip(c_start, c_end, tokens, strict=True):
                    score = formats.score(token)
                    if score >= 0:
                        spans.append((a, 3, b, score))
                spans.sort(key=lambda s: s[:2])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in spans])
            yield pa.record_batch([batch["doc_id"], pa.array(out, kinds)], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
