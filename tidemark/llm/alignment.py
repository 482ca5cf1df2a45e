"""Alignment of two tokenizers' tokens over the same bytes, and how far the corpus agrees on it.

Tokens of a text by a byte-level vocabulary (A) and by a vocabulary of pieces (B) end at byte
offsets; where both end is a cut, and cuts part the tokens into groups. Groups are found by
divide and conquer: near the middle of an interval a common end is looked for by bisection,
both halves are treated likewise, and an interval without a cut is a group. The upper levels
of the recursion are the same in every text: neither vocabulary has a token that goes on from
other characters into white space, or (if the vocabularies allow) from a letter or digit into
a closing mark, so such places are cuts. What lies between them, a segment, is encoded and
divided once and remembered, so a text costs its segments' look-ups.

Tokens of a group whose bytes overlap are links. The corpus-wide count of a pair of ids is the
number of documents that hold it linked, of which a document gets the sum over its links, and
the number of links that are the best of their A id. Workers write, for each block of some
megabytes of text, the distinct pairs and every document's places and times among them; pairs
are summed in Spark, and their counts go back to the blocks, one row per pair and block, where
they are added up. So no row is made per token, and no table of pairs is held in one place. A
block is written as many rows, each with some of its pairs and the documents of some text.

Defined results: a null or empty text, and one whose tokens' bytes differ from the text with
a space before it (as where it spells a vocabulary's own space mark), has no tokens: counts are
nought and its groups an empty string; repeated rows, repeated and null ids are documents of
their own; strings of special tokens are plain text; texts without white space are one segment
however long; an empty table gives none; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WIDE_ROWS, give_back, packed, read_table, unpacked, worker_state
from tidemark.llm.registry import query
from tidemark.llm.tokens import byte_alphabet
from tidemark.session import cut_lineage

#: Bytes of text in a block.
BLOCK_BYTES = 24_000_000
#: Pieces a Python worker remembers, and their bytes, before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 300_000, 32_000_000
#: Bytes of text that are looked up together, and units that are aligned together.
SLICE_BYTES, LEARNED_AT_ONCE = 1_500_000, 50_000
#: Pairs in a row of a block.
ROW_PAIRS = 5_000
#: Probes around the middle that intervals make together; bits of an id in a pair.
FAR_PROBES, PAIR_BITS = 32, 20
_MARK, _GUARD = "▁", "\n"
#: A space after anything but white space; runs of white space are never cut.
_BREAK = re.compile(
    rb"\x20(?<![\x00-\x20\x7f]\x20)(?<!\xc2[\x85\xa0]\x20)(?<!\xe1\x9a\x80\x20)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf]\x20)(?<!\xe2\x81\x9f\x20)(?<!\xe3\x80\x80\x20)"
)
#: Without these every space of a text is such a space.
_RUNS = (b"\x20\x20", b"\n\x20", b"\t\x20", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_CONTROL = re.compile(rb"[\x00-\x08\x0b-\x1f\x7f]")
#: Fixed value: what a byte-level vocabulary is split at before its merges.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = r"(?<=[A-Za-z0-9])"
_CLOSING = ".,;:!?"


def cuts(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) up to each common end, by divide and conquer.

    Both lists ascend and end alike. An end near the middle of A's is looked up in B's; where it
    is not common its neighbours are tried, ever farther from the middle.
    """
    out = []
    # Intervals still to do, the leftmost on top; (a, b) tokens lie before one, (c, d) up to its end.
    todo = [(0, 0, len(ends_a), len(ends_b))]
    while todo:
        a, b, c, d = todo.pop()
        middle = (a + c - 1) // 2
        for step in range(c - a):
            # The middle, one after, one before, two after, ..; the interval's own end is no cut inside.
            k = middle + (step + 1) // 2 * (1 if step % 2 else -1)
            if not a <= k < c - 1:
                continue
            place = bisect_left(ends_b, ends_a[k], b, d - 1)
            if place < d - 1 and ends_b[place] == ends_a[k]:
                todo += [(k + 1, place + 1, c, d), (a, b, k + 1, place + 1)]
                break
        else:
            out.append((c, d))
    return out


def cuts_of_many(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A tokens up to each common end in many intervals [first, last) at a time, in order.

    All ends are counted on from one interval to the next. The intervals of a round are probed
    and halved together; one whose cut is far from its middle is left to ``cuts``.
    """
    found = [last]
    low, high, step = first, last, np.zeros(len(first), np.int64)
    while len(low):
        open_ = high - low > 1
        far = open_ & (step > FAR_PROBES)
        for a, c in zip(low[far].tolist(), high[far].tolist(), strict=True):
            before = ends_a[a - 1] if a else 0
            b, d = np.searchsorted(ends_b, [before, ends_a[c - 1]], "right")
            found.append(a + np.array([k for k, _ in cuts(ends_a[a:c].tolist(), ends_b[b:d].tolist())[:-1]], np.int64))
        open_ &= ~far
        low, high, step = low[open_], high[open_], step[open_]
        # The middle, one after, one before, two after, ..; an interval's own end is no cut inside.
        k = (low + high - 1) // 2 + (step + 1) // 2 * np.where(step % 2, 1, -1)
        inside = (k >= low) & (k < high - 1)
        end = ends_a[np.where(inside, k, low)]
        hit = inside & (ends_b[np.searchsorted(ends_b, end)] == end)
        cut = k[hit] + 1
        found.append(cut)
        left = ~hit & (step <= 2 * (high - low))
        low, high, step = (
            np.concatenate([low[hit], cut, low[left]]), np.concatenate([cut, high[hit], high[left]]),
            np.concatenate([np.zeros(2 * len(cut), np.int64), step[left] + 1]),
        )
    return np.sort(np.concatenate(found))


def gathered(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs ``at`` of a list of runs that begin at ``starts``, and the runs' sizes."""
    sizes = starts[at + 1] - starts[at]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + sizes, sizes), sizes


class Aligner:
    """Both tokenizers, and what a worker has learned of pieces between spaces."""

    def __init__(self, path_a: str, path_b: str) -> None:
        # Spark has a worker for every core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        spelt = {i: bytes(alphabet[c] for c in t) for t, i in vocabulary.items() if all(c in alphabet for c in t)}
        self.bytes_a = [spelt.get(i, b"") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        # What a token is followed by in a text of groups.
        self.said_a = [f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"]
        self.said_b = [f"{i}{c}" for i in range(len(pieces)) for c in (",", ";", "")]
        plain = [p.replace(_MARK, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        if any(re.search(r"\S\x20", p) or _GUARD in p for p in plain):
            raise ValueError("a piece goes on into a space or holds a line end")
        closing = "".join(c for c in _CLOSING if not any(re.search(_LETTERS + re.escape(c), p, re.ASCII) for p in plain))
        #: Places inside a segment that both vocabularies always cut.
        self.inner = re.compile(r"(?<=\S)(?=\n)" + (f"|{_LETTERS}(?=[{re.escape(closing)}](?![A-Za-z0-9]))" if closing else ""))
        self.closing = closing
        self.lead = len(self.b.encode(_GUARD))
        self.fast = self._same_vocabulary(path_a, spelt)
        if self.fast:
            self.a = None  # tens of MB that are not asked again
        self.forget()
        give_back()

    def _same_vocabulary(self, path: str, spelt: dict[int, bytes]):
        """An encoder of the same ids, several times as fast, if the ids of A are the order of its merges."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split, merges = model["pre_tokenizer"], model["model"].get("merges", [])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        ids = [model["model"]["vocab"].get("".join(m)) for m in pairs]
        if model["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or ids != list(range(256, 256 + len(ids))):
            return None
        import tiktoken

        ranks = {b: i for i, b in spelt.items() if i < 256 + len(ids)}
        return tiktoken.Encoding("a", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        #: Where each piece's units begin in ``parts``.
        self.starts, self.parts = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.size = 0
        self.units: dict[str, int] = {}
        self.groups: list[bytes] = []
        #: A row a unit: tokens of A and of B, groups, links, and whether its bytes disagree.
        self.figures = np.zeros((0, 5), np.int64)
        #: Where each unit's links, as pairs of ids, begin in ``linked``.
        self.link_starts, self.linked = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.known) > REMEMBERED or self.size > REMEMBERED_BYTES

    def pieces(self, text: bytes) -> list[bytes]:
        """What follows each space that is a cut, the first space being put before the text."""
        if text.startswith(b"\x20") or any(r in text for r in _RUNS) or _CONTROL.search(text):
            return _BREAK.split(b" " + text)[1:]
        return text.split(b" ")

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A and B ids of parts of a text: nothing is put before them."""
        if self.fast:
            ids_a = [self.fast.encode_ordinary(u) for u in units]
        else:
            ids_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # The space put before a text and a line end are tokens of their own, so they come off cleanly.
        return ids_a, [ids[self.lead :] for ids in self.b.encode([_GUARD + u for u in units], num_threads=1)]

    def learn_units(self, units: list[str]) -> None:
        """Encode and align units, all of them at a time."""
        encoded = self.encode(units)
        data = [u.encode() for u in units]
        agree = np.ones(len(units), bool)
        spelt = [b"".join(map(known.__getitem__, chain.from_iterable(ids))) for known, ids in zip((self.bytes_a, self.bytes_b), encoded, strict=True)]
        if spelt[0] != (whole := b"".join(data)) or spelt[1] != whole:
            for k, d in enumerate(data):
                agree[k] = all(b"".join(map(known.__getitem__, ids[k])) == d for known, ids in zip((self.bytes_a, self.bytes_b), encoded, strict=True))
            encoded = tuple([x if ok else [] for x, ok in zip(ids, agree, strict=True)] for ids in encoded)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in encoded)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in zip(encoded, (n_a, n_b), strict=True))
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        last_a, last_b, full = np.cumsum(n_a), np.cumsum(n_b), n_a > 0
        cut = cuts_of_many(ends_a, ends_b, (last_a - n_a)[full], last_a[full])
        groups = np.diff(np.searchsorted(cut, last_a, "right"), prepend=0)
        # Between two neighbouring ends of either kind lies the overlap of one pair.
        ends = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, ends)] << PAIR_BITS | b[np.searchsorted(ends_b, ends)]
        self.linked = np.concatenate([self.linked, pairs])
        n_links = n_a + n_b - groups
        self.link_starts = np.concatenate([self.link_starts, self.link_starts[-1] + np.cumsum(n_links)])
        self.figures = np.concatenate([self.figures, np.stack([n_a, n_b, groups, n_links, ~agree], axis=1)])
        # Groups as text: each token with what follows it, A's before B's in every group.
        cut_b = np.searchsorted(ends_b, ends_a[cut - 1], "right")
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[cut - 1] = closes_b[cut_b - 1] = 1
        closes_b[last_b[full] - 1] = 2
        group_a, group_b = (np.repeat(np.arange(len(cut)), np.diff(c, prepend=0)) for c in (cut, cut_b))
        said = np.empty(len(a) + len(b), np.int64)
        said[np.arange(len(a)) + np.concatenate([[0], cut_b])[group_a]] = a * 2 + closes_a
        said[np.arange(len(b)) + cut[group_b]] = ~(b * 3 + closes_b)
        words = [self.said_a[i] if i >= 0 else self.said_b[~i] for i in said.tolist()]
        at = 0
        for unit, n in zip(units, (n_a + n_b).tolist(), strict=True):
            self.units[unit] = len(self.groups)
            self.groups.append("".join(words[at : at + n]).encode())
            at += n

    def learn(self, pieces: set[bytes]) -> None:
        """Remember pieces by their units: what lies between places that are always cuts."""
        split = []
        for p in sorted(pieces):
            text = " " + p.decode()
            split.append(self.inner.split(text) if text[-1] in self.closing or "\n" in text or not text[1:].isalpha() else [text])
            self.known[p] = len(self.known)
            self.size += len(p)
        new = sorted({u for units in split for u in units if u not in self.units})
        for first in range(0, len(new), LEARNED_AT_ONCE):
            self.learn_units(new[first : first + LEARNED_AT_ONCE])
        self.parts = np.concatenate([self.parts, np.fromiter(map(self.units.__getitem__, chain.from_iterable(split)), np.int64)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([*map(len, split)])])

    def documents(self, found: list[list[bytes]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts in known pieces: figures, digests of the groups, and their distinct pairs.

        The pairs come as one list, with how often a text links each and how many a text has.
        """
        pieces = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64)
        places, sizes = gathered(self.starts, pieces)
        units, ends = self.parts[places], np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([*map(len, found)])]
        figures = np.diff(np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.figures[units], axis=0)])[ends], axis=0, prepend=np.zeros((1, 5), np.int64))
        listed, starts, good = units.tolist(), np.concatenate([[0], ends[:-1]]).tolist(), (figures[:, 4] == 0) & (figures[:, 0] > 0)
        digests = [
            hashlib.sha256(b";".join(map(self.groups.__getitem__, listed[i:j]))).hexdigest() if ok else "" for i, j, ok in zip(starts, ends.tolist(), good.tolist(), strict=True)
        ]
        figures[~good] = 0
        owner = np.repeat(np.arange(len(found)), np.diff(ends, prepend=0))
        kept = good[owner]
        places, sizes = gathered(self.link_starts, units[kept])
        keys = np.sort(np.repeat(owner[kept], sizes) << 2 * PAIR_BITS | self.linked[places])
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        pairs = keys[new] & ((1 << 2 * PAIR_BITS) - 1)
        return figures, digests, pairs, np.diff(new, append=len(keys)), np.bincount(keys[new] >> 2 * PAIR_BITS, minlength=len(found))


def aligner(path_a: str, path_b: str) -> Aligner:
    return worker_state(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def block_table(docs: DataFrame, paths: tuple[str, str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents in blocks: their figures, and their pairs as places among the block's pairs.

    A block is some rows; ``first`` is the place of a row's first pair. The places of a document
    are the ``steps`` from one to the next, which go on from document to document in a row.
    """
    lists = [
        ("doc_id", pa.int64()), *((n, pa.int64()) for n in _FIGURES), ("groups_sha256", pa.string()),
        ("sizes", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("held", pa.int32()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = aligner(*paths)
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def save() -> Iterator[pa.RecordBatch]:
            numbers = np.unique(np.concatenate([distinct for *_, distinct, _, _, _ in held]))
            n = np.zeros(len(numbers), np.int64)
            for *_, distinct, count, _, _ in held:
                n[np.searchsorted(numbers, distinct)] += count
            for first, part in zip_longest(range(0, len(numbers), ROW_PAIRS), held):
                of = slice(0, 0) if first is None else slice(first, first + ROW_PAIRS)
                columns, steps, times = [[] for _ in lists[:-3]], packed(np.zeros(0)), packed(np.zeros(0))
                if part:
                    ids, figures, digests, sizes, distinct, _, places, times = part
                    columns = [ids, *(figures[:, k] for k in range(len(_FIGURES))), digests, sizes]
                    # The pairs of a document ascend, so the steps between their places are small.
                    steps = packed(np.diff(np.searchsorted(numbers, distinct)[places], prepend=0))
                columns += [numbers[of] >> PAIR_BITS, numbers[of] & ((1 << PAIR_BITS) - 1), n[of]]
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c).cast(t)) for c, (_, t) in zip(columns, lists, strict=True)]
                arrays += [pa.array([block], pa.int64()), pa.array([first or 0], pa.int32()), pa.array([steps], pa.binary()), pa.array([times], pa.binary())]
                yield pa.record_batch(arrays, names=[*[n for n, _ in lists], "block", "first", "steps", "times"])

        for batch in batches:
            texts = batch[1].cast(pa.binary())
            first = 0
            while first < batch.num_rows:
                taken, part = 0, []
                while first + len(part) < batch.num_rows and taken < min(SLICE_BYTES, block_bytes):
                    part.append(texts[first + len(part)].as_py() or b"")
                    taken += len(part[-1])
                found = [both.pieces(t) if t else [] for t in part]
                new = set().union(*found).difference(both.known)
                if new:
                    both.learn(new)
                figures, digests, pairs, times, sizes = both.documents(found)
                distinct, places, count = np.unique(pairs, return_inverse=True, return_counts=True)
                held.append((batch[0].slice(first, len(part)).to_pylist(), figures, digests, sizes, distinct, count, places.astype(np.int32), packed(times)))
                size, first = size + taken, first + len(part)
                if size >= block_bytes:
                    yield from save()
                    block, held, size = block + 1, [], 0
                if both.full():
                    both.forget()
                    give_back()
        if held:
            yield from save()
        # The worker outlives its task: what it has learned would stay, idle beside the JVM.
        batch, texts, part, found, new, pairs, places, held = *[None] * 7, []
        both.forget()
        give_back()

    types = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    schema = ", ".join(f"{n} array<{types[t]}>" for n, t in lists) + ", block long, first int, steps binary, times binary"
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return cut_lineage(rows.mapInArrow(run, schema), compression="zstd", **WIDE_ROWS)


def align_documents(docs: DataFrame, tokenizers: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row the tokens, groups and links of both tokenizers, and the corpus's counts over the links."""
    blocks = block_table(docs, tokenizers or default_tokenizers(), block_bytes)
    listed = blocks.select("block", "first", F.posexplode(F.arrays_zip("a", "b", "held")).alias("i", "x"))
    listed = listed.select("block", (F.col("first") + F.col("i")).alias("i"), "x.a", "x.b", "x.held")
    pairs = listed.groupBy("a", "b").agg(F.sum("held").alias("n"))
    # An A id has at most as many rows as B has ids.
    best = F.max("n").over(Window.partitionBy("a")) == F.col("n")
    figures = listed.drop("held").join(pairs.withColumn("best", best), ["a", "b"]).select("block", "i", "n", "best")

    def add_up(texts: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        order = found["i"].to_numpy()
        n, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        n[order], best[order] = found["n"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)

        def part(row: pa.Table) -> pa.Table:
            column = lambda name: row[name].combine_chunks().flatten()
            ends = np.cumsum(column("sizes").to_numpy().astype(np.int64))
            places, times = np.cumsum(unpacked(row["steps"][0].as_py(), ends[-1])), unpacked(row["times"][0].as_py(), ends[-1])

            def total(values: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)

            out = {name: column(name) for name in ("doc_id", *_FIGURES)}
            return pa.table(out | {"n_best": total(times * best[places]), "count_sum": total(times * n[places]), "groups_sha256": column("groups_sha256")})

        return pa.concat_tables([part(texts.slice(k, 1)) for k in range(texts.num_rows)])

    texts = blocks.where(F.size("doc_id") > 0).select(F.col("block").alias("of"), "doc_id", *_FIGURES, "groups_sha256", "sizes", "steps", "times")
    both = texts.groupBy("of").cogroup(figures.groupBy("block"))
    return both.applyInArrow(add_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read_table(spark, sf_dir, "documents"))
