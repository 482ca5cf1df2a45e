"""Document likelihood over all segmentations into subwords.

The pieces of an existing vocabulary weight the edges of each word's lattice, and a forward
recursion in log space sums over its segmentations. A text's probability is the product over
its words (a piece begins a word or lies inside one, none spans white space) and the end
token. The vocabulary stays as it is: its file's scores, ranks of a merge order, become a
prior (one over the rank), which one pass of expected piece counts over the training words
(forward and backward, weighted by the words' counts) brings in line with the corpus.

Texts are read once, into blocks: the distinct words of some megabytes of text with their
training counts, and for each document the numbers and counts of its words. Words of all
blocks are summed in Spark, every distinct word is scored once, and the figures go back to
the blocks, where they are added up per document. So a frequent word is one row per block
and no row per occurrence, and nothing that grows with the corpus is held in one place; the
expected counts on the driver are one number per piece. A block is written as many rows, each
with some of its words and some of its documents, so no row is larger than a few hundred kB
(or than one document's words).

Defined results: a null or empty text is its end token alone; a null id trains, as the crc32
of an empty text is nought; rows are scored one by one, also repeated ones; long words are
scored whole; characters without a piece go through the pieces of their bytes; without
training rows every count is nought; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WIDE_ROWS, carry, give_back, join_counted, packed, read_table, unpacked
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

#: Bytes of text in a block.
BLOCK_BYTES = 24_000_000
#: Words, and words of documents, in a row of a block.
ROW_WORDS, ROW_PLACES = 5_000, 25_000
#: Pieces that the prior counts as seen, shared out by its weights.
PRIOR_PIECES = 10_000.0
FOLDS, HELD_OUT = 5, 1
END = b""
_START = "▁"
#: Scores below mark pieces that are never used.
_UNUSED = -1e8


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a vocabulary file with the weights of its scores."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.bytes = [-1] * 256
        weights = np.zeros(size + 1)
        for i in range(size):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
                weights[i] = 1.0 / size
            elif not (model.is_control(i) or model.is_unknown(i)) and model.get_score(i) > _UNUSED:
                self.pieces[model.id_to_piece(i)] = i
                weights[i] = 1.0 / (2.0 - model.get_score(i))
        self.end = size
        if min(self.bytes) < 0:  # a vocabulary without byte pieces gets them
            self.bytes = list(range(size + 1, size + 257))
            weights = np.concatenate([weights, np.full(256, 1.0 / size)])
        weights[self.end] = 1.0 / size
        self.prior = weights / weights.sum()


class Lattice:
    """All segmentations of words under given piece probabilities."""

    def __init__(self, vocabulary: Vocabulary, probability: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            self.logs = np.log(probability).tolist()
        self.end = self.logs[vocabulary.end]
        self.end_piece = vocabulary.end
        self.bytes = vocabulary.bytes
        # Every start of a piece is an entry, so that a search ends with the last possible piece.
        self.known: dict[str, int] = {}
        for piece, i in vocabulary.pieces.items():
            for n in range(1, len(piece)):
                self.known.setdefault(piece[:n], -1)
            self.known[piece] = i

    def edges(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place, the (start, pieces, log weight) of the edges that end there."""
        n, known, logs = len(word), self.known, self.logs
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            one = known.get(word[i], -2)
            if one < 0:
                spelt = tuple(self.bytes[b] for b in word[i].encode("utf-8", "surrogatepass"))
                into[i + 1].append((i, spelt, sum(logs[b] for b in spelt)))
                if one == -2:
                    continue
            else:
                into[i + 1].append((i, (one,), logs[one]))
            for j in range(i + 2, n + 1):
                piece = known.get(word[i:j], -2)
                if piece >= 0:
                    into[j].append((i, (piece,), logs[piece]))
                elif piece == -2:
                    break
        return into

    def forward(self, into: list) -> list[float]:
        log, exp = math.log, math.exp
        alpha = [0.0]
        for edges in into[1:]:
            if len(edges) == 1:
                alpha.append(alpha[edges[0][0]] + edges[0][2])
                continue
            values = [alpha[i] + w for i, _, w in edges]
            top = max(values)
            alpha.append(top + log(sum([exp(v - top) for v in values])))
        return alpha

    def score(self, word: bytes) -> float:
        """Natural log of a word's probability summed over its segmentations."""
        if word == END:
            return self.end
        return self.forward(self.edges(_START + word.decode()))[-1]

    def expect(self, word: bytes, count: float, counts: list[float]) -> None:
        """Add the expected uses of each piece in ``count`` occurrences of a word."""
        if word == END:
            counts[self.end_piece] += count
            return
        into = self.edges(_START + word.decode())
        alpha = self.forward(into)
        # Share of the probability that passes a place, going back from the end.
        share = [0.0] * len(into)
        share[-1] = count
        for j in range(len(into) - 1, 0, -1):
            if share[j] > 0.0:
                for i, pieces, w in into[j]:
                    part = share[j] * math.exp(alpha[i] + w - alpha[j])
                    share[i] += part
                    for p in pieces:
                        counts[p] += part


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def block_table(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents as blocks of words and counts, a block being some rows.

    ``first`` is the number of a row's first word in its block. The words of a document are the
    ``steps`` from one word's number to the next, which go on from document to document in a row.
    """
    fields = [
        ("block", pa.int64()), ("first", pa.int32()), ("words", pa.list_(pa.binary())), ("train", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("steps", pa.binary()), ("times", pa.binary()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        number: dict[bytes, int] = {}
        ids, held, at, times, size = [], [], [], [], 0

        def save() -> Iterator[pa.RecordBatch]:
            words, train = list(number), np.zeros(len(number), np.int64)
            for places, n, out in zip(at, times, held, strict=True):
                if not out:
                    train[places] += n
            # Documents of a row are those that begin within the same ROW_PLACES places.
            starts = np.concatenate([[0], np.cumsum([*map(len, at)])[:-1]])
            bounds = [*np.flatnonzero(np.diff(starts // ROW_PLACES, prepend=-1)).tolist(), len(at)]
            for first, of in zip_longest(range(0, len(words), ROW_WORDS), zip(bounds, bounds[1:], strict=False)):
                of_words = slice(0, 0) if first is None else slice(first, first + ROW_WORDS)
                of_docs = slice(*(of or (0, 0)))
                steps = np.diff(np.concatenate([np.zeros(1, np.int32), *at[of_docs]]))
                columns = (
                    block, first or 0, words[of_words], train[of_words], ids[of_docs], held[of_docs], [*map(len, at[of_docs])],
                    packed(steps), packed(np.concatenate([np.zeros(0, np.int32), *times[of_docs]])),
                )
                yield pa.record_batch([pa.array([c], t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            texts = batch[1].cast(pa.binary())
            for i, doc_id in enumerate(batch[0].to_pylist()):
                text = texts[i].as_py() or b""
                found = text.lower().split()
                found.append(END)
                numbers = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))
                places, counts = np.unique(numbers, return_counts=True)
                ids.append(doc_id)
                held.append(held_out(doc_id))
                at.append(places)
                times.append(counts.astype(np.int32))
                size += len(text)
                if size >= block_bytes:
                    yield from save()
                    block, number, size = block + 1, {}, 0
                    ids, held, at, times = [], [], [], []
                    give_back()
        if ids:
            yield from save()
        number = batch = texts = None
        ids, held, at, times = [], [], [], []
        give_back()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    schema = "block long, first int, words array<binary>, train array<long>, doc_id array<long>, held array<boolean>, sizes array<int>, steps binary, times binary"
    return cut_lineage(rows.mapInArrow(run, schema), **WIDE_ROWS)


def train(spark: SparkSession, words: DataFrame, vocabulary: Vocabulary) -> Lattice:
    """Piece probabilities after one pass of expected counts over the training words."""
    shared = carry(spark, Lattice(vocabulary, vocabulary.prior), "lattice")
    size = len(vocabulary.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = shared(), [0.0] * size
        for batch in batches:
            for word, c in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                lattice.expect(word, float(c), counts)
        used = [i for i, c in enumerate(counts) if c]
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array([counts[i] for i in used], pa.float64())], names=["piece", "uses"])

    seen = words.where("c > 0").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    counts = PRIOR_PIECES * vocabulary.prior
    for row in seen.collect():  # a row per piece of the vocabulary at most
        counts[row.piece] += row.uses
    return Lattice(vocabulary, counts / counts.sum())


def score_documents(docs: DataFrame, vocabulary: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: counts, the unigram ``base_score`` and the lattice ``score``, both log10."""
    spark = docs.sparkSession
    blocks = block_table(docs, block_bytes)
    listed = blocks.select("block", "first", F.posexplode(F.arrays_zip("words", "train")).alias("i", "x"))
    counted = listed.select("block", (F.col("first") + F.col("i")).alias("i"), F.col("x.words").alias("word"), F.col("x.train").alias("c"))
    words = cut_lineage(counted.groupBy("word").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("_n")))
    totals = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    tokens, distinct = totals.n or 0, totals.v or 0
    shared = carry(spark, train(spark, words, Vocabulary(vocabulary or default_vocabulary())), "lattice")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared()
        for batch in batches:
            logs = [lattice.score(w) for w in batch[0].to_pylist()]
            yield pa.record_batch([batch[0], batch[1], batch[2], pa.array(logs, pa.float64())], names=["word", "c", "_n", "log_p"])

    scored = cut_lineage(words.mapInArrow(score, "word binary, c long, _n long, log_p double"))
    # A word of very many blocks meets its row in each of them, and not all in one task.
    figures = join_counted(counted.select("block", "i", "word"), scored, ["word"]).select("block", "i", "c", "log_p")

    def add_up(texts: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        order = found["i"].to_numpy()
        c, log_p = np.zeros(len(order), np.int64), np.zeros(len(order))
        c[order], log_p[order] = found["c"].to_numpy(), found["log_p"].to_numpy()
        base, seen = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1))), c > 0

        def part(row: pa.Table) -> pa.Table:
            ids, held, sizes = (row[name].combine_chunks().flatten() for name in ("doc_id", "held", "sizes"))
            sizes = sizes.to_numpy().astype(np.int64)
            starts, n = np.concatenate([[0], np.cumsum(sizes)[:-1]]), int(sizes.sum())
            at, times = np.cumsum(unpacked(row["steps"][0].as_py(), n)), unpacked(row["times"][0].as_py(), n)
            total = lambda values: np.add.reduceat(values, starts)
            return pa.table(
                {
                    "doc_id": ids,
                    "held_out": held,
                    "n_tokens": total(times),
                    "n_known": total(times * seen[at]),
                    "train_tokens": np.full(len(ids), tokens, np.int64),
                    "base_score": total(times * base[at]),
                    "score": total(times * log_p[at]) / math.log(10),
                }
            )

        return pa.concat_tables([part(texts.slice(k, 1)) for k in range(texts.num_rows)])

    texts = blocks.where(F.size("doc_id") > 0).select(F.col("block").alias("of"), "doc_id", "held", "sizes", "steps", "times")
    both = texts.groupBy("of").cogroup(figures.groupBy("block"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.applyInArrow(add_up, schema)


@query("op3_lattice")
def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
