"""URL rules as one bit-parallel automaton.

All glob patterns are packed into rows of 64-bit words, one bit for every place in a pattern
(Shift-And). A step over a byte shifts the reached places whose next element takes that byte
and keeps those whose ``*`` takes it; every pattern and every URL of a batch move together.

Patterns are matched against the canonical URL, host (A-Z lower-cased) and path joined, as
UTF-8. ``?`` is one byte but ``/``, ``*`` any run of bytes without ``/``, ``**`` any run.

Path rules (host, path start) are compiled to such patterns too: the host itself and ``*.``
before it. The longest rule that fits decides; of equally long ones the first listed. URLs
that no path rule fits are judged by the block patterns, any match blocks.

Defined results: a null URL, or one without ``://``, has an empty host and path; repeated
rows stay rows, an empty table gives none; long URLs are matched whole; further columns are
kept by ``judge``, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ascii_lower, read_table
from tidemark.llm.registry import query

#: (verdict, host and path start), as the table's owner lists them.
PATH_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Mobile mirrors, advertising, sessions and downloads.
BLOCK_PATTERNS = ("m.*/**", "ads.*/**", "ads-*/**", "*.ads.*/**", "**/ads/**", "**/login**", "**/cart/**", "**.exe", "**.zip")

_SLASH = ord("/")


class GlobAutomaton:
    """Multiword Shift-And masks of globs."""

    def __init__(self, patterns: Sequence[str]) -> None:
        takes, loops, starts, ends = [], [], [], []
        for pattern in patterns:
            starts.append(len(takes))
            data, i = pattern.encode(), 0
            loop: str | None = None
            while i < len(data):
                if data[i : i + 2] == b"**":
                    loop, i = "any", i + 2
                elif data[i : i + 1] == b"*":
                    loop, i = loop or "part", i + 1
                else:
                    takes.append("part" if data[i : i + 1] == b"?" else data[i])
                    loops.append(loop)
                    loop, i = None, i + 1
            takes.append(None)
            loops.append(loop)
            ends.append(len(takes) - 1)
        places = len(takes)
        self.words = max(1, -(-places // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.ends = [(e // 64, np.uint64(e % 64)) for e in ends]
        for p in range(places):
            word, bit = p // 64, np.uint64(1 << (p % 64))
            for table, kind in ((self.step, takes[p]), (self.stay, loops[p])):
                if isinstance(kind, int):
                    table[kind, word] |= bit
                elif kind is not None:
                    for c in range(256):
                        if kind == "any" or c != _SLASH:
                            table[c, word] |= bit
        for s in starts:
            self.first[s // 64] |= np.uint64(1 << (s % 64))

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Matrix of (URL, pattern) matches."""
        sizes = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        state = np.tile(self.first, (len(urls), 1))
        for t in range(int(sizes[0]) if len(urls) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))  # URLs longer than t
            byte = flat[begin[:live] + t]
            now = state[:live]
            moved = now & self.step[byte]
            shifted = moved << np.uint64(1)
            shifted[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            state[:live] = shifted | (now & self.stay[byte])
        out = np.zeros((len(urls), len(self.ends)), bool)
        for k, (word, bit) in enumerate(self.ends):
            out[order, k] = (state[:, word] >> bit) & np.uint64(1)
        return out


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = PATH_RULES, patterns: Sequence[str] = BLOCK_PATTERNS
) -> DataFrame:
    """All columns of the pages with ``host``, ``path``, ``rule`` and ``verdict``."""
    results = ("host", "path", "rule", "verdict")
    listed = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    globs = []
    for i in listed:
        host, path = rules[i][1].split("/", 1)
        globs += [f"{host}/{path}**", f"*.{host}/{path}**"]
    machine = GlobAutomaton([*globs, *patterns])
    names = [rules[i][1] for i in listed]
    said = [rules[i][0] for i in listed]

    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    cut = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in results], host.alias("host"), path.alias("path"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in cut.schema]).add("rule", "string").add("verdict", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["host"].cast(pa.string()).to_pylist(), batch["path"].cast(pa.string()).to_pylist(), strict=True)
            found = machine.match([f"{h}{p}".encode() for h, p in pairs])
            by_rule = found[:, : len(globs)].reshape(len(found), len(names), 2).any(2)
            blocked = found[:, len(globs) :].any(1)
            fits = by_rule.any(1)
            first = by_rule.argmax(1) if names else np.zeros(len(found), int)
            rule = [names[k] if ok else None for k, ok in zip(first, fits, strict=True)]
            verdict = [said[k] if ok else "block" if bad else "allow" for k, ok, bad in zip(first, fits, blocked, strict=True)]
            columns = [batch[i] for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return cut.mapInArrow(run, schema)


OP10_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '^(m\\.[^/]*/|ads[.-][^/]*/|[^/]*\\.ads\\.[^/]*/)|/ads/|/login|/cart/|\\.exe$|\\.zip$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


@query("op10_url_rules", OP10_SQL)
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
