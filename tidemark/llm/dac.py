"""Token ids in directly addressable codes: files with random access to any token.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of
every token, level k the next chunk of the tokens that have one, in order. Each level but the
last has a continuation bitmap, and a rank directory that counts its set bits up to every
512th, so the place of a token's next chunk is one directory entry and at most eight words of
bitmap away: no block is decoded.

File: the magic ``TDAC1``, three zero bytes, the length of a JSON header (8 bytes, little
endian), the header padded to eight bytes, then the sections it lists (name, place, bytes):
``doc_id``, ``doc_null``, ``start`` (tokens before each document in the file, and all), and
``chunks``, ``bits``, ``ranks`` of each level.

Documents are range-partitioned and sorted by id, and every task writes files of bounded size
under names of its own; only files named by the manifest, which Spark commits, are read.

Defined results: a null or empty text is its end id alone; null ids come first; repeated ids
are documents of their own, in the order of their texts; an empty table gives no file and no
row; further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import file_system, new_folder, read_table
from tidemark.llm.registry import query
from tidemark.llm.tokens import default_tokenizer, encoded_rows, ids_crc32
from tidemark.session import cut_lineage

MAGIC = b"TDAC1\0\0\0"
CHUNK_BITS = 8
RANK_EVERY = 512
#: Tokens of one file; a longer document has a file to itself.
FILE_TOKENS = 16_000_000


def levels_of(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, continuation bitmap, rank directory) of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 1 << CHUNK_BITS
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY), dtype=np.uint64) if len(more) else more[:0]
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        last = not more.any()
        out.append(((rest & 0xFF).astype(np.uint8).tobytes(), b"" if last else bits.tobytes(), b"" if last else ranks.tobytes()))
        if last:
            return out
        rest = rest[more] >> CHUNK_BITS


def file_bytes(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    sections = {
        "doc_id": np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        "doc_null": np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        "start": np.cumsum([0, *map(len, docs)]).astype("<u8").tobytes(),
    }
    levels = levels_of(ids)
    for k, parts in enumerate(levels):
        sections |= {f"{name}{k}": part for name, part in zip(("chunks", "bits", "ranks"), parts, strict=True)}
    place, listed = 0, []
    for name, part in sections.items():
        listed.append([name, place, len(part)])
        place += len(part) + -len(part) % 8
    head = json.dumps({"tokens": len(ids), "docs": len(docs), "levels": len(levels), "sections": listed}).encode()
    head += b" " * (-len(head) % 8)
    body = b"".join(part + b"\0" * (-len(part) % 8) for part in sections.values())
    return MAGIC + len(head).to_bytes(8, "little") + head + body


class DacFile:
    """Reader over anything with ``read_at(bytes, place)``, such as an opened file."""

    def __init__(self, source) -> None:
        self.source = source
        lead = source.read_at(16, 0)
        if lead[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n = int.from_bytes(lead[8:], "little")
        self.header = json.loads(source.read_at(n, 16))
        self.sections = {name: (16 + n + place, size) for name, place, size in self.header["sections"]}

    def section(self, name: str, dtype, start: int = 0, count: int | None = None) -> np.ndarray:
        place, size = self.sections[name]
        width = np.dtype(dtype).itemsize
        count = size // width - start if count is None else min(count, size // width - start)
        return np.frombuffer(self.source.read_at(count * width, place + start * width), dtype)

    def token(self, i: int) -> int:
        """One token: a byte, a bit and a rank a level."""
        value = 0
        for k in range(self.header["levels"]):
            value |= int(self.section(f"chunks{k}", np.uint8, i, 1)[0]) << CHUNK_BITS * k
            if not self.sections[f"bits{k}"][1]:
                break
            block = i // RANK_EVERY
            bits = np.unpackbits(self.section(f"bits{k}", np.uint8, block * RANK_EVERY // 8, RANK_EVERY // 8), bitorder="little")
            if not bits[i % RANK_EVERY]:
                break
            i = int(self.section(f"ranks{k}", "<u8", block, 1)[0]) + int(bits[: i % RANK_EVERY].sum())
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """A run of tokens; of each level only the bytes that belong to the run are read."""
        out = self.section("chunks0", np.uint8, start, end - start).astype(np.uint32)
        at = np.arange(len(out))
        for k in range(1, self.header["levels"]):
            first = start // RANK_EVERY * RANK_EVERY
            bits = np.unpackbits(self.section(f"bits{k - 1}", np.uint8, first // 8, (end - first + 7) // 8), bitorder="little")
            before = int(self.section(f"ranks{k - 1}", "<u8", first // RANK_EVERY, 1)[0]) + int(bits[: start - first].sum())
            at = at[np.flatnonzero(bits[start - first : end - first])]
            if not len(at):
                break
            start, end = before, before + len(at)
            out[at] |= self.section(f"chunks{k}", np.uint8, start, end - start).astype(np.uint32) << np.uint32(CHUNK_BITS * k)
        return out

    def documents(self) -> list[int | None]:
        return [None if null else int(d) for d, null in zip(self.section("doc_id", "<i8"), self.section("doc_null", np.uint8), strict=True)]


def write_dac(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write all documents in the order of their ids; the manifest, one row per file."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        part, held, ids, tokens, number = TaskContext.get().partitionId(), [], [], 0, 0

        def save() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{root}/{name}") as sink:
                sink.write(file_bytes(held, ids))
            return pa.record_batch([pa.array([v], t) for v, t in ((name, pa.string()), (part, pa.int64()), (number, pa.int64()), (len(held), pa.int64()), (tokens, pa.int64()))], names=["file", "part", "number", "docs", "tokens"])

        for doc_id, doc in encoded_rows(batches, path, end_id):
            if held and tokens + len(doc) > file_tokens:
                yield save()
                held, ids, tokens, number = [], [], 0, number + 1
            held.append(doc_id)
            ids.append(doc)
            tokens += len(doc)
        if held:
            yield save()

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut_lineage(ordered.mapInArrow(run, "file string, part long, number long, docs long, tokens long"))


def read_dac(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the manifest's files: id, place in the whole, tokens and their crc32."""
    # One row per file, so the running sum of the manifest is small work for one task.
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for file, before in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{file}") as source:
                    dac = DacFile(source_at(source))
                    start = dac.section("start", "<u8").astype(np.int64)
                    ids = dac.tokens(0, int(start[-1]))
                    crcs = [ids_crc32(ids[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
                    columns = (dac.documents(), start[:-1] + before, np.diff(start), crcs)
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class source_at:
    """``read_at`` over a pyarrow file."""

    def __init__(self, source) -> None:
        self.source = source

    def read_at(self, count: int, place: int) -> bytes:
        self.source.seek(place)
        return self.source.read(count)


@query("op6_dac")
def op6_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "dac")
    return read_dac(write_dac(read_table(spark, sf_dir, "documents"), folder), folder)
