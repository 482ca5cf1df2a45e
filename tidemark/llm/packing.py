"""Cost-balanced packing of documents into training sequences.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``, the second term for attention
inside a piece. Documents of a chunk are taken longest first and each goes to the sequence of
the lowest cost so far that still has room for it; a document that fits nowhere is cut and
fills the roomiest sequences. The capacities of a chunk add up to its tokens: sequences of
``capacity`` tokens, and the rest in sequences of the powers of two that make up the
remainder, so no token of padding is needed. A chunk is a bounded run of documents of one
input split, so packing needs no shuffle and no task sees more than its split.

Defined results: a null or empty text is a document of the end token alone; repeated rows and
repeated or null ids are documents of their own; texts longer than a sequence are cut; an
empty table gives no pieces; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read_table
from tidemark.llm.registry import query
from tidemark.llm.tokens import default_tokenizer, encoded_rows, ids_crc32

CAPACITY = 4096
#: Tokens that are balanced together in one task; bounds its memory.
CHUNK_TOKENS = 4_000_000

_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64()),
]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def capacities(tokens: int, capacity: int) -> list[int]:
    """Sequence sizes that hold exactly ``tokens``: full ones, then powers of two."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of the given documents."""
    room = np.array(capacities(sum(lengths), capacity), dtype=np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    pieces = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, int(size[seq] - room[seq])))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    seq, rests = 0, []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:  # whole sequences of one document
            put(doc, start, capacity, seq)
            start, seq = start + capacity, seq + 1
        rests.append((n - start, doc, start))
    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fits = room >= n
            if fits.any():
                put(doc, start, n, int(np.where(fits, cost, np.inf).argmin()))
                break
            seq = int(room.argmax())
            part = int(room[seq])
            put(doc, start, part, seq)
            start, n = start + part, n - part
    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 2,
    capacity: int = CAPACITY,
    linear: float = 1.0,
    quadratic: float = 1.0 / CAPACITY,
    chunk_tokens: int = CHUNK_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``), with their ids on request."""
    if capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    path = tokenizer or default_tokenizer()
    fields = [*_FIELDS, ("ids", pa.list_(pa.int32()))] if with_ids else _FIELDS

    def chunk(held: list, first: int) -> tuple[pa.RecordBatch, int]:
        ids = [h[1] for h in held]
        rows = balance([len(x) for x in ids], capacity, linear, quadratic)
        rows.sort(key=lambda r: (r[3], r[4]))
        cut = [ids[d][s : s + n] for d, s, n, _, _ in rows]
        columns = [
            [held[d][0] for d, *_ in rows], [r[1] for r in rows], [r[2] for r in rows], [ids_crc32(c) for c in cut],
            [len(ids[d]) for d, *_ in rows], [first + r[3] for r in rows], [r[4] for r in rows],
            [linear * r[2] + quadratic * r[2] * r[2] for r in rows],
        ]
        if with_ids:
            columns.append([c.astype(np.int32) for c in cut])
        arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
        return pa.record_batch(arrays, names=[n for n, _ in fields]), first + len(capacities(sum(map(len, ids)), capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, tokens, first = [], 0, TaskContext.get().partitionId() << 32
        for doc_id, ids in encoded_rows(batches, path, end_id):
            held.append((doc_id, ids))
            tokens += len(ids)
            if tokens >= chunk_tokens:
                out, first = chunk(held, first)
                yield out
                held, tokens = [], 0
        if held:
            yield chunk(held, first)[0]

    schema = _SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
