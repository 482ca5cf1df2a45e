"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton is built over words of the items. Streaming a document's words through it gives,
at every word, the longest run ending there that occurs in some item. A run of at least
``window`` words, or a whole item of fewer words, is contamination; which items hold the last
``window`` words is read off the state. Only runs of words that occur in the items are
streamed, as any other word brings the automaton back to its root.

Distinct items are taken in blocks by a running sum of their words, so a block holds less than
``block_words`` words and one item more. Each block is one automaton, built in a task and
written to the shared folder; the driver holds the files' names. All documents pass all blocks
without a shuffle, a worker holding one automaton at a time.

Defined results: a null or empty text has no words and no hit; an item without words never
occurs; items with equal ids count once, a null id as the text ``null``; repeated documents
are rows of their own; without items nothing is hit; further columns of the documents stay,
whatever their names.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ascii_lower, boxed, file_system, last_state, new_folder, read_table
from tidemark.llm.registry import query
from tidemark.operators.skew import running
from tidemark.session import cut_lineage

WINDOW = 10
#: Words of the items in one automaton.
BLOCK_WORDS = 2_000_000
#: Share of hit words above which a whole document goes.
MAX_COVERAGE = 0.5

#: Lower-cases A-Z and turns every other ASCII character that is not alphanumeric into a space.
FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
#: A word of a text whose A-Z are in lower case, as the fold leaves it.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of its windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for name, found in items:
            if found:
                numbered.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found]))
        for _, run in numbered:
            last = 0
            for word in run:
                last = self._extend(last, word)
        self.at_window = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            if self.length[state] >= window:
                up = self.link[state]
                self.at_window[state] = self.at_window[up] if self.length[up] >= window else state
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, run in numbered:
            state = 0
            for i, word in enumerate(run):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.items.setdefault(self.at_window[state], set()).add(name)
            if len(run) < window:
                self.short.setdefault(state, {}).setdefault(len(run), set()).add(name)
        self.short_up = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.short_up[state] = state if state in self.short else self.short_up[self.link[state]] if state else -1
        self.least = min([window, *(m for by in self.short.values() for m in by)])

    def _extend(self, last: int, word: int) -> int:
        """The state of the run so far with one more word."""
        nxt, link, length = self.next, self.link, self.length

        def split(p: int, q: int) -> int:
            copy = len(link)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and nxt[p].get(word) == q:
                nxt[p][word] = copy
                p = link[p]
            link[q] = copy
            return copy

        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def search(self, found: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [start, end) spans of hit words, and the items that occur."""
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least
        spans: list[list[int]] = []
        items: set[str] = set()

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state, matched = 0, 0
            for i, word in enumerate(ids[a:b].tolist(), a + 1):
                while state and word not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                step = self.next[state].get(word)
                if step is None:
                    continue
                state, matched = step, matched + 1
                if matched >= self.window:
                    hit(i - matched, i)
                    items |= self.items[self.at_window[state]]
                up = self.short_up[state]
                while up >= 0:
                    for m, names in self.short[up].items():
                        if m <= matched:
                            hit(i - m, i)
                            items |= names
                    up = self.short_up[self.link[up]] if up else -1
        return spans, items


def automata(benchmark: DataFrame, folder: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Files of the automata of all blocks of items, in the order of the items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)).cast("long")
    items = cut_lineage(items.distinct().withColumn("n", n).where("n > 0"))
    before = running(items, [], ["item_id", "text"], {"before": ("sum", F.col("n"))}, inclusive=False)
    blocks = before.select(F.floor(F.coalesce("before", F.lit(0)) / block_words).alias("block"), "item_id", "text")

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True))
        machine = Automaton([(i, t.encode().translate(FOLD).split()) for i, t in rows], window)
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.automaton"
        with system.open_output_stream(f"{root}/{name}") as sink:
            sink.write(pickle.dumps(vars(machine)))
        return pa.table({"block": table["block"].slice(0, 1), "file": [name]})

    # A file that a lost task left behind is not listed.
    built = cut_lineage(blocks.groupBy("block").applyInArrow(build, "block long, file string"))
    return [r.file for r in built.orderBy("block").collect()]


def opened(folder: str, file: str) -> Automaton:
    """An automaton from its file; a worker keeps the last one."""

    def read() -> Automaton:
        system, root = file_system(folder)
        machine = Automaton.__new__(Automaton)
        with system.open_input_stream(f"{root}/{file}") as source:
            vars(machine).update(pickle.loads(source.read()))
        return machine

    return last_state("automaton", file, read)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, with_left: bool = False) -> DataFrame:
    """``_row`` (all columns of the documents), ``n_words``, ``hits`` (word spans) and ``items``.

    On request also ``left``: the text without its hits, null for a text that has none.
    """
    spark = docs.sparkSession
    text_at = docs.columns.index("text")
    folder = new_folder(spark, "automata")
    files = automata(benchmark, folder, window, block_words)
    left = [F.lit(None).cast("string").alias("left")] if with_left else []
    out = docs.select(
        boxed(docs), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("hits"), F.array().cast("array<string>").alias("items"), *left
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[0].field(text_at).cast(pa.string()).cast(pa.binary())
            counts = [0] * batch.num_rows
            hits: list[list[list[int]]] = [[] for _ in counts]
            items: list[set[str]] = [set() for _ in counts]
            for place, file in enumerate(files or [None]):
                machine = opened(folder, file) if file else None
                for i in range(batch.num_rows):
                    found = (texts[i].as_py() or b"").translate(FOLD).split()
                    if not place:
                        counts[i] = len(found)
                    if found and machine:
                        new, now = machine.search(found)
                        hits[i] = union(hits[i] + new) if hits[i] and new else hits[i] or new
                        items[i] |= now
            columns = [
                batch[0], pa.array(counts, pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in h] for h in hits], batch.schema.field("hits").type),
                pa.array([sorted(names) for names in items], batch.schema.field("items").type),
            ]
            if with_left:
                cut = [cut_words(texts[i].as_py().decode(errors="replace"), h) if h else None for i, h in enumerate(hits)]
                columns.append(pa.array(cut, batch.schema.field("left").type))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return out.mapInArrow(run, schema)


def union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut_words(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the given word spans; white space around a cut becomes one space."""
    if text is None or not spans:
        return text
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.translate(FOLD))]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : places[start][0]].rstrip())
        at = places[end - 1][1]
    out.append(data[at:].lstrip())
    return b" ".join(p for p in out if p).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Documents without hit spans; those with a larger share of hit words than allowed go."""
    # Cut where they are found: a function of its own would take a second Python worker a core.
    found = find_hits(docs, benchmark, window, block_words, with_left=True)
    kept = found.where((F.size("hits") == 0) | (n_hit() <= max_coverage * F.col("n_words")))
    text = F.when(F.size("hits") > 0, F.col("left")).otherwise(F.col("_row.text"))
    return kept.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])


def digest(found: DataFrame) -> DataFrame:
    """The counts of ``find_hits`` per document."""
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP9_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS k
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS k
  FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT g.r, g.p, g.n, x.item FROM grams g JOIN windows x ON g.n = x.n AND g.k = x.k),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""


@query("op9_decontaminate", OP9_SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find_hits(docs, read_table(spark, sf_dir, "benchmark")))
