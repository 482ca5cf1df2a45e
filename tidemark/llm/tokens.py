"""Token ids of whole texts by the tokenizers library, at the price of the distinct words."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import worker_state

#: Distinct words and parts of words a Python worker learns before it forgets those it didn't meet since the last time.
REMEMBERED = 200_000
#: Longer words are forgotten at once.
LONG_WORD = 64
#: Bytes of text that are encoded together; a longer text is taken alone.
SLICE_BYTES = 8_000_000

# The normal forms and the pattern of word tokenizers whose parts can be encoded one by one.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same parts of small ASCII letters, and line breaks between words.
_ASCII_PARTS = rb"\n|[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9a-z]+"
#: Latin words: none of their characters composes with another, or has a small form of several.
_LATIN = "[!-~\u00a1-\u012f\u0131-\u024f]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Packed ids of texts.

    Where a tokenizer drops white space and folds case, the ids of a text are those of its
    words one after the other, so each distinct word is encoded once for many texts. This
    is tried out on a probe when the encoder is made; any other tokenizer encodes whole texts,
    and so does a text that spells a special token. Where the tokenizer's file has the known
    normal forms and pattern, a Latin word is the ids of its parts, for which the library's
    model is asked directly; other words go through the whole of the library. The parts of
    ASCII words and all other words are remembered.
    """

    def __init__(self, path: str) -> None:
        # Spark has a worker for every core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = bool(self.special) and self._ids("Ab c,\nD. e\x0bf") == [i for w in ("ab", "c,", "d.", "e", "f") for i in self._ids(w)]
        self.marks = sorted({s[:2] for s in self.special})
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.model = self.tokenizer.model if self._in_parts(file) else None
        self.latin, self.parts = regex.compile(_LATIN), regex.compile(rf"\n|{_PARTS}")
        self.ascii_parts = re.compile(_ASCII_PARTS)
        self.alphabet = {b: c for c, b in byte_alphabet().items()}

    @staticmethod
    def _in_parts(file: dict) -> bool:
        normal, split = file["normalizer"] or {}, (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = {"type": "Split", "pattern": {"Regex": _PARTS}, "behavior": "Removed", "invert": True}
        plain = len(split) == 2 and split[0] == known and split[1]["type"] == "ByteLevel" and not split[1]["use_regex"] and not split[1]["add_prefix_space"]
        return normal.get("normalizers") == _NORMAL and plain and not file["model"].get("dropout")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids: Iterable[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text; words new to the worker are learned together."""
        return self.encode_column(pa.array(texts, pa.binary()).view(pa.string()))

    def encode_column(self, texts: pa.StringArray) -> list[bytes]:
        """Packed ids of each text of a column without nulls.

        Arrow finds the distinct words of all texts, and copies their ids to where they occur.
        """
        out: list[bytes | None] = [None] * len(texts)
        whole = np.full(len(texts), not self.by_word)
        for mark in self.marks if self.by_word else ():
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._pack(self._ids(texts[i].as_py()))
        others = np.flatnonzero(~whole)
        if len(others):
            # Taken, as ascii_lower goes wrong on a slice that was cast.
            words = pc.ascii_split_whitespace(pc.ascii_lower(texts.take(pa.array(others))))
            coded = words.flatten().dictionary_encode()
            ids = self._ids_of(coded.dictionary).take(coded.indices)
            ends, packed = _bounds(ids)[words.offsets.to_numpy()].tolist(), memoryview(ids.buffers()[2] or b"")
            for k, i in enumerate(others.tolist()):
                out[i] = bytes(packed[ends[k] : ends[k + 1]])
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        return out

    def _ids_of(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Packed ids of each of the distinct words of some texts."""
        if self.model is None:
            return self._known_ids(words.view(pa.binary()).to_pylist(), self._learn_whole)
        ascii = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        if ascii.all():
            return self._ids_in_parts(words.view(pa.binary()), self.ascii_parts)
        odd = words.filter(pa.array(~ascii)).view(pa.binary()).to_pylist()
        texts = [w.decode() for w in odd]
        latin = np.array([self.latin.fullmatch(t) is not None for t in texts])
        small = "\n".join(t for t, known in zip(texts, latin, strict=True) if known).lower()
        kinds = [
            self._ids_in_parts(words.filter(pa.array(ascii)).view(pa.binary()), self.ascii_parts),
            self._ids_in_parts(pa.array(small.split("\n") if small else [], pa.string()), self.parts),
            self._known_ids([w for w, known in zip(odd, latin, strict=True) if not known], self._learn_whole),
        ]
        kind = np.zeros(len(words), np.int8)
        kind[~ascii] = 2 - latin
        place = np.empty(len(words), np.int64)
        place[np.argsort(kind, kind="stable")] = np.arange(len(words))
        return pa.concat_arrays(kinds).take(pa.array(place))

    def _ids_in_parts(self, words: pa.BinaryArray | pa.StringArray, pattern) -> pa.LargeBinaryArray:
        """Ids of small words: those of their parts, found in all words at once."""
        if not len(words):
            return pa.array([], pa.large_binary())
        gap = b"\n" if pa.types.is_binary(words.type) else "\n"
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), gap)[0].as_py()
        coded = pa.array([*pattern.findall(joined), gap], words.type).dictionary_encode()
        ids = self._known_ids(coded.dictionary.view(pa.binary()).to_pylist(), self._learn_parts).take(coded.indices)
        # A word ends at its line break, which has no ids.
        breaks = np.flatnonzero(coded.indices.to_numpy() == coded.dictionary.index(gap).as_py())
        bounds = np.concatenate([[0], _bounds(ids)[breaks]])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), ids.buffers()[2]])

    def _known_ids(self, distinct: list[bytes], learn: Callable[[set[bytes]], None]) -> pa.LargeBinaryArray:
        known, before = self.known, self.before
        new = set(distinct).difference(known)
        for word in new.intersection(before):
            known[word] = before[word]
        learn(new.difference(before))
        ids = pa.array(map(known.__getitem__, distinct), pa.large_binary(), size=len(distinct))
        for word in new:
            if len(word) > LONG_WORD:
                del known[word]
        return ids

    def _learn_parts(self, new: Iterable[bytes]) -> None:
        """What the tokenizer's pattern keeps together; a line break is none."""
        for part in new:
            spelt = part.decode() if part.isalnum() else part.decode("latin-1").translate(self.alphabet)
            self.known[part] = self._pack([t.id for t in self.model.tokenize(spelt)]) if part != b"\n" else b""

    def _learn_whole(self, new: Iterable[bytes]) -> None:
        words, gap = list(new), self.special[0]
        texts = [gap.join(w.decode() for w in words[i : i + 128]) for i in range(0, len(words), 128)]
        gap_id = self.tokenizer.token_to_id(gap)
        place = 0
        for encoded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.asarray(encoded.ids, dtype=np.int64)
            for part in np.split(ids, np.flatnonzero(ids == gap_id)):
                self.known[words[place]] = self._pack((part[1:] if len(part) and part[0] == gap_id else part).tolist())
                place += 1


def _bounds(packed: pa.LargeBinaryArray) -> np.ndarray:
    """Where each value begins in the bytes of an array without nulls, and the end of the last."""
    return np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encoded_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids with the end id) of rows (id, text), a few texts at a time whatever the batch."""
    encode = encoder(path)
    end = np.array([end_id], dtype=encode.dtype).tobytes()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch[1], "")
        sizes, first = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while first < batch.num_rows:
            reach = SLICE_BYTES + (int(sizes[first - 1]) if first else 0)
            last = min(int(np.searchsorted(sizes, reach)) + 1, batch.num_rows)
            part = texts.slice(first, last - first).cast(pa.string())
            for doc_id, ids in zip(batch[0].slice(first, last - first).to_pylist(), encode.encode_column(part), strict=True):
                yield doc_id, np.frombuffer(ids + end, dtype=encode.dtype)
            first = last
            del part
            # A worker outlives its task: it holds the distinct words, not what finding them took.
            pa.default_memory_pool().release_unused()


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    return worker_state(("encoder", path), lambda: WordEncoder(path))


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
