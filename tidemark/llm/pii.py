"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Four patterns (email, ip, card, phone) give the base spans, which always stay. Looser shapes of
the same kinds (spelt-out mail addresses, IPv6, numbers like cards or national phone numbers)
are candidates. Five labelers vote on every base span and candidate, for (1), against (-1) or
not at all (0):

* ``pattern``: a regular expression, for what the base pattern takes;
* ``structure``: a regular expression or checksum (Luhn, digit groups, address parts, domain);
* ``gazetteer``: top-level domains, card issuers, country codes, reserved networks;
* ``context``: words of four languages in the ``REACH`` characters before the span;
* ``border``: whether the span is glued to letters or digits.

Expectation-maximisation over the counts of all vote patterns of the corpus estimates, a kind,
how often each labeler votes which way on personal and on other spans (a labeler that errs
often weighs little). The resulting probabilities are soft labels of a logistic regression a
kind over votes and shape (number of digits, separators), and candidates it gives at least
``THRESHOLD`` are added, under the name of their kind.

A span's votes and shape are one number, its signature, of which there are at most
``4 * 3**5 * 8 * 32``, so the corpus reaches the driver as counts of signatures, a table of a
proven bound; counts are taken over all documents, none is sampled. Texts are read once.

Defined results: a null or empty text has no span; offsets are code points, the end exclusive;
equal rows get equal results; a candidate that touches a base span, or one that begins
earlier, is none; without candidates nothing is added; an empty table gives none; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("pattern", "structure", "gazetteer", "context", "border")

# The base patterns (an address's name is what stands before its sign).
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

# Looser shapes.
_AT = re.compile(r"[\[(]\x20?at\x20?[\])]\x20?", re.IGNORECASE)
_SPELT = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]+)+", re.IGNORECASE)
_COLONS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])")
_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
LOOSE_CARD, LOOSE_PHONE = (13, 19), (9, 15)
_NAME_REACH = 64

# Gazetteers.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name io co ai app dev eu de fr es it uk ie us ca mx br ar cl at ch be nl lu pt pl cz se no dk fi gr ru ua tr jp cn in au nz za test example".split()
)
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "64", "7", "81", "82", "86", "90", "91", "351", "352", "353", "358", "380", "420")
ISSUERS = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}")
CUES = {
    EMAIL: frozenset("email mail e-mail contact write courriel contacter correo contacto kontakt schreiben address adresse".split()),
    IP: frozenset("ip host server address login logged client adresse connexion serveur direccion servidor anmeldung gateway".split()),
    CARD: frozenset("card visa mastercard amex credit debit carte crédit bancaire tarjeta crédito kreditkarte karte cc payment".split()),
    PHONE: frozenset("phone tel telephone call mobile cell fax téléphone portable appelez teléfono móvil llame telefon handy anruf rufnummer whatsapp".split()),
}
AGAINST = frozenset("isbn issn version release order invoice item article number no id ref serial sku commande facture numéro pedido factura número bestellung rechnung nummer artikel".split())

#: Characters before a span whose words are its context.
REACH = 40
#: Probability from which a candidate is personal data.
THRESHOLD = 0.5
#: Spans each labeler is taken to have voted on before the corpus is seen, and its votes then.
PRIOR = 8.0
# Shares of the votes (-1, 0, 1) on other spans and on personal ones.
_BELIEF = np.array([[0.45, 0.45, 0.10], [0.10, 0.45, 0.45]])
RIDGE = 1.0
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_SEPARATORS = " .-(["
_SIZES = (0, 8, 10, 12, 13, 16, 17)
SIGNATURES = len(KINDS) * 3 ** len(LABELERS) * (len(_SIZES) + 1) * (1 << len(_SEPARATORS))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(digits: str) -> int | None:
    """The number of an address part, if it is one of at most 255; leading noughts count nothing."""
    short = digits.lstrip("0")
    return int(short or 0) if len(short) <= 3 and int(short or 0) <= 255 else None


def _within(n: int, bounds: tuple[int, int]) -> bool:
    return bounds[0] <= n <= bounds[1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans in order, in time that grows with the text alone."""
    out, last, sign = [], 0, text.find("@")
    while sign >= 0:
        # A name holds no sign, so it begins after the sign or the address before.
        name = text[last:sign]
        start = last + len(name.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        last = domain.end() if domain else sign + 1
        if domain:
            out.append((start, EMAIL, last))
        sign = text.find("@", last)
    for m in _DOTTED.finditer(text):
        # Four parts at a time, as a scan from the left takes them.
        if m[0].count(".") >= 3:
            places = [p.span() for p in re.finditer("[0-9]+", m[0])]
            for k in range(0, len(places) - 3, 4):
                if all(_byte(m[0][a:b]) is not None for a, b in places[k : k + 4]):
                    out.append((m.start() + places[k][0], IP, m.start() + places[k + 3][1]))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() >= CARD_DIGITS[0] else ""
        if _within(len(digits), CARD_DIGITS) and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        out += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if _within(len(_digits(m[0])), PHONE_DIGITS)]
    out.sort()
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates apart from the base spans and from each other."""
    found = []
    if "at" in text or "AT" in text or "At" in text or "aT" in text:
        for m in _AT.finditer(text):
            left = text[max(0, m.start() - _NAME_REACH - 1) : m.start()]
            name = left.removesuffix(" ")
            size = len(name) - len(name.rstrip(_LOCAL))
            domain = _SPELT.match(text, m.end()) if 0 < size <= _NAME_REACH else None
            if domain:
                found.append((m.start() - len(left) + len(name) - size, EMAIL, domain.end()))
    if text.count(":") >= 3:
        for m in _COLONS.finditer(text):
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            found.append((m.start(), IP, m.end()))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < LOOSE_PHONE[0]:
            continue
        n, marks = len(_digits(m[0])), {c for c in m[0] if not "0" <= c <= "9"}
        if _within(n, LOOSE_CARD) and marks <= {" ", "-"} and "(" not in marks and _CARD.fullmatch(m[0]):
            found.append((m.start(), CARD, m.end()))
        elif _within(n, LOOSE_PHONE) and marks:
            found.append((m.start(), PHONE, m.end()))
    found.sort()
    out, k, reach = [], 0, 0
    for start, kind, end in found:
        while k < len(base) and base[k][0] < end:
            reach, k = max(reach, base[k][2]), k + 1
        if start >= reach:
            out.append((start, kind, end))
            reach = end
    return out


def structure(kind: int, s: str) -> int:
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]+", s.rstrip("])"))[-1]
        return 1 if len(last) >= 2 and last.isalpha() else -1
    if kind == IP:
        return 1 if ":" in s or all(p == "0" or p[0] != "0" for p in s.split(".")) else -1
    if kind == CARD:
        return 1 if luhn(_digits(s)) else -1
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    return 1 if len(groups) >= 3 and max(groups) <= 5 else -1 if len(groups) == 1 else 0


def gazetteer(kind: int, s: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[^A-Za-z0-9-]+", s)[-1].lower() in TOP_DOMAINS else -1
    if kind == IP:
        if ":" not in s:
            parts = [_byte(p) or 0 for p in s.split(".")]
            if max(parts) < 20:  # versions and chapter numbers
                return -1
            s = ".".join(map(str, parts))
        address = ipaddress.ip_address(s)
        return -1 if address.is_unspecified or address.is_loopback or address.is_multicast else 1
    digits = _digits(s)
    if kind == CARD:
        return 1 if ISSUERS.fullmatch(digits) else -1
    if s[0] == "+":
        return 1 if digits.startswith(COUNTRY_CODES) else -1
    return 1 if (digits[0] == "0" and digits[1] != "0") or (len(digits) == 10 and digits[0] in "23456789") else -1


def context(kind: int, before: str) -> int:
    words = {w.lower() for w in _WORD.findall(before)}
    return (not words.isdisjoint(CUES[kind])) - (not words.isdisjoint(AGAINST))


def border(text: str, start: int, end: int) -> int:
    near = text[start - 1 : start] if start else "", text[end : end + 1]
    return -1 if any(c.isalnum() or c in "_/=" for c in near if c) else 1


def signature(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """Votes and shape of a span as one number."""
    s = text[start:end]
    code = kind
    for vote in (int(base), structure(kind, s), gazetteer(kind, s), context(kind, text[max(0, start - REACH) : start]), border(text, start, end)):
        code = code * 3 + vote + 1
    n = sum("0" <= c <= "9" for c in s)
    code = code * (len(_SIZES) + 1) + sum(n >= b for b in _SIZES)
    return code << len(_SEPARATORS) | sum((c in s) << i for i, c in enumerate(_SEPARATORS))


def unfolded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kinds, votes from 0 to 2, features) of signatures."""
    marks = codes[:, None] >> np.arange(len(_SEPARATORS)) & 1
    rest = codes >> len(_SEPARATORS)
    sizes = rest % (len(_SIZES) + 1)
    rest = rest // (len(_SIZES) + 1)
    votes = rest[:, None] // 3 ** np.arange(len(LABELERS) - 1, -1, -1) % 3
    each = [votes == 0, votes == 2, sizes[:, None] == np.arange(1, len(_SIZES) + 1), marks]
    return rest // 3 ** len(LABELERS), votes, np.concatenate([np.ones((len(codes), 1)), *each], axis=1).astype(float)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each vote pattern to be personal data, and the labelers' votes on either class.

    Expectation: a pattern's class given the labelers' vote shares. Maximisation: the shares given
    the classes, with ``PRIOR`` spans that vote as believed.
    """
    shares = np.repeat(_BELIEF[:, None, :], votes.shape[1], axis=1)
    weight = np.array([0.5, 0.5])
    place = np.arange(votes.shape[1])
    chance = np.full(len(votes), 0.5)
    for _ in range(rounds):
        logs = np.log(weight)[:, None] + np.stack([np.log(shares[y][place, votes]).sum(1) for y in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        done = np.abs(new - chance).max() < 1e-10
        chance = new
        for y, q in enumerate((1 - chance, chance)):
            got = np.stack([np.bincount(votes[:, j], weights=q * counts, minlength=3) for j in place])
            shares[y] = (got + PRIOR * _BELIEF[y]) / ((q * counts).sum() + PRIOR)
            weight[y] = ((q * counts).sum() + 1) / (counts.sum() + 2)
        if done:
            break
    return chance, shares


def classifier(x: np.ndarray, soft: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - soft)) + RIDGE * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        # Long steps are cut, as the curve flattens far from the middle.
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def infer(counted: list[tuple[int, int]]) -> dict[int, float]:
    """Probability of every signature, from the counts of all of the corpus."""
    codes, counts = (np.array(c, np.int64) for c in zip(*sorted(counted), strict=True))
    kinds, votes, features = unfolded(codes)
    out: dict[int, float] = {}
    for kind in np.unique(kinds):
        at = kinds == kind
        n = counts[at].astype(float)
        soft, _ = estimate(votes[at], n)
        w = classifier(features[at], soft, n)
        for code, z in zip(codes[at].tolist(), (features[at] @ w).tolist(), strict=True):
            out[code] = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row all spans in order: ``start``, ``end``, ``kind``, whether ``base``, and ``code``."""
    fields = [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("base", pa.bool_()), ("code", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            for text in batch[1].to_pylist():
                base = base_spans(text or "")
                spans = sorted([(a, k, b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in loose_spans(text or "", base)])
                rows = [(a, b, k, sure, signature(text, k, a, b, sure)) for a, k, b, sure in spans]
                for i, column in enumerate(columns):
                    column.append([r[i] for r in rows])
            yield pa.record_batch([batch[0], *[pa.array(c, pa.list_(t)) for c, (_, t) in zip(columns, fields, strict=True)]], names=["doc_id", *[n for n, _ in fields]])

    schema = "doc_id long, start array<long>, end array<long>, kind array<int>, base array<boolean>, code array<long>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def find_personal(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row ``doc_id`` and its spans (``kind``, ``start``, ``end``, ``base``, ``score``) in order."""
    found = cut_lineage(scan(docs))
    counted = found.select(F.explode("code").alias("code")).groupBy("code").count().collect()
    chances = docs.sparkSession.sparkContext.broadcast(infer([(r["code"], r["count"]) for r in counted]) if counted else {})
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = chances.value
        for batch in batches:
            out = []
            for row in zip(*(batch[n].to_pylist() for n in ("start", "end", "kind", "base", "code")), strict=True):
                out.append(
                    [
                        {"kind": KINDS[k], "start": a, "end": b, "base": sure, "score": chance[code]}
                        for a, b, k, sure, code in zip(*row, strict=True)
                        if sure or chance[code] >= threshold
                    ]
                )
            yield pa.record_batch([batch["doc_id"], pa.array(out, spans)], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>")


@query("op12_personal")
def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
