"""Token ids as wavelet matrices, one compressed file per shard.

A wavelet matrix keeps a sequence of ids as one bit-plane per bit of the
largest id, from the highest: each plane holds that bit of every id in the current
order, and the next plane's order puts the ids with a 0 before those with a 1. A
directory of counts, one entry for each 512 bits, makes rank constant-time and
select a binary search; it is part of the file. From the one file, an id at a place, the number of times that an id
occurs before a place, and the places of an id follow in as many steps as there
are planes. The head of the file has the place of every plane and directory, and each is
compressed by itself, so a reader reads and unpacks a plane when it first needs it.

Texts are tokenized whole, in the order of their partition; a shard closes at
the end of the document that brings it to shard_tokens. Nothing is shuffled.
token_shards gives the files as a column, save_shards writes them to a folder, find_token
looks an id up in all of them.

Nulls: a null text has no tokens, like an empty one, and keeps its place; null
doc_ids are kept. Very long texts are one document of a shard that is as long as they need; runs of
white space are cut by us, because the pattern's backtracking fails on long ones. Ties and
repeated rows are documents like others. An empty table gives no shard; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.secrets import VOCABULARY, encoding

SHARD_TOKENS = 1 << 20
MAGIC = b"WVM2"
#: Bits of a word, and words between entries of the directory.
WORD, SPAN = 64, 8
#: A run of so many white spaces or more is cut before the vocabulary's pattern sees it.
LONG_SPACE = 1024
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def token_ids(text: str, path: str = VOCABULARY, long_space: int = LONG_SPACE) -> np.ndarray:
    """Ids of a text, as the vocabulary's pattern and merges give them.

    Of a run of white space that something follows, the pattern takes all but the last
    character as one piece, at the end of the text all; so a long run is taken out here.
    """
    enc, parts, at = encoding(path), [], 0
    for m in re.finditer(f"[{_SPACES}]{{{max(2, long_space)},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        parts.append(enc.encode_to_numpy(text[at : m.start()], disallowed_special=()))
        parts.append(np.array(enc._encode_single_piece(text[m.start() : end]), np.uint32))
        at = end
    parts.append(enc.encode_to_numpy(text[at:], disallowed_special=()))
    return parts[0].astype(np.uint32) if len(parts) == 1 else np.concatenate(parts).astype(np.uint32)


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], load: Callable[[int], tuple[np.ndarray, np.ndarray]]):
        """zeros: bits of 0 in each plane; load: of a level, its words in rows of SPAN, and the bits of 1 before each row."""
        self.n, self.zeros, self._load = n, zeros, load
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def depth(self) -> int:
        return len(self.zeros)

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.unpacked:
            self.unpacked[level] = self._load(level)
        return self.unpacked[level]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids)
        depth = max(1, int(ids.max(initial=0)).bit_length())
        a = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(depth - 1, -1, -1):
            bit = (a >> level) & 1 != 0
            packed = np.packbits(bit, bitorder="little")
            # A row more than needed, so that the end has its directory entry too.
            words = np.zeros(len(a) // (WORD * SPAN) * SPAN + SPAN, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            words = words.reshape(-1, SPAN)
            ones = np.cumsum(np.bitwise_count(words).sum(1, dtype=np.int64))
            planes.append((words, np.concatenate(([0], ones[:-1]))))
            low = a[~bit]
            zeros.append(len(low))
            a = np.concatenate((low, a[bit]))
        return cls(len(ids), zeros, planes.__getitem__)

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Bits of 1 before each of the places i."""
        words, before = self.plane(level)
        row, word = i // (WORD * SPAN), i // WORD % SPAN
        counts = np.bitwise_count(words[row]).astype(np.int64)
        counts[np.arange(SPAN) >= word[:, None]] = 0
        part = words[row, word] & ((np.uint64(1) << (i % WORD).astype(np.uint64)) - np.uint64(1))
        return before[row] + counts.sum(1) + np.bitwise_count(part)

    def access(self, places) -> np.ndarray:
        """Ids at places."""
        i = np.atleast_1d(np.asarray(places, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("no such place")
        out = np.zeros(len(i), np.int64)
        for level in range(self.depth):
            words, _ = self.plane(level)
            one = (words[i // (WORD * SPAN), i // WORD % SPAN] >> (i % WORD).astype(np.uint64)) & np.uint64(1) != 0
            ones = self._rank1(level, i)
            i = np.where(one, self.zeros[level] + ones, i - ones)
            out = out * 2 + one
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where in the last order the occurrences of token before end lie."""
        ab = np.array([0, end])
        if token < 0 or token >> self.depth:
            return 0, 0
        for level in range(self.depth):
            if ab[0] == ab[1]:
                return 0, 0
            ones = self._rank1(level, ab)
            ab = ones + self.zeros[level] if token >> (self.depth - 1 - level) & 1 else ab - ones
        return int(ab[0]), int(ab[1])

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of token before end."""
        a, b = self._range(token, self.n if end is None else end)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """Places of token, by select through the planes."""
        a, b = self._range(token, self.n)
        i = np.arange(a, b)
        if not len(i):
            return i
        for level in range(self.depth - 1, -1, -1):
            words, before = self.plane(level)
            one = token >> (self.depth - 1 - level) & 1
            nth = i - self.zeros[level] if one else i
            counts = before if one else np.arange(len(before)) * (WORD * SPAN) - before
            row = np.searchsorted(counts, nth, side="right") - 1
            there = words[row] if one else ~words[row]
            upto = np.cumsum(np.bitwise_count(there), axis=1, dtype=np.int64)
            left = nth - counts[row]
            word = (upto <= left[:, None]).sum(1)
            each = np.arange(len(i))
            left = left - np.where(word > 0, upto[each, word - 1], 0)
            bits, at = there[each, word], np.zeros(len(i), np.int64)
            for step in (32, 16, 8, 4, 2, 1):
                part = np.bitwise_count((bits >> at.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
                skip = left >= part
                left, at = left - part * skip, at + step * skip
            i = (row * SPAN + word) * WORD + at
        return i

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1)
        parts = [pack.compress(x.tobytes()) for level in range(self.depth) for x in (self.plane(level)[0], self.plane(level)[1].astype(np.uint32))]
        at, head = _HEAD.size + self.depth * _ENTRY.size, [_HEAD.pack(MAGIC, self.n, self.depth)]
        for level, zeros in enumerate(self.zeros):
            sizes = [len(x) for x in parts[2 * level : 2 * level + 2]]
            head.append(_ENTRY.pack(zeros, at, *sizes))
            at += sum(sizes)
        return b"".join(head + parts)

    @classmethod
    def read(cls, part: Callable[[int, int], bytes]) -> WaveletMatrix:
        """From part(offset, size) of a file; planes are read when they are needed."""
        magic, n, depth = _HEAD.unpack(part(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        table = list(_ENTRY.iter_unpack(part(_HEAD.size, depth * _ENTRY.size)))
        size = (n // (WORD * SPAN) + 1) * SPAN * 8

        def load(level: int) -> tuple[np.ndarray, np.ndarray]:
            _, at, plane, directory = table[level]
            data, unpack = part(at, plane + directory), zstandard.ZstdDecompressor()
            words = np.frombuffer(unpack.decompress(data[:plane], max_output_size=size), np.uint64).reshape(-1, SPAN)
            return words, np.frombuffer(unpack.decompress(data[plane:], max_output_size=size), np.uint32).astype(np.int64)

        return cls(n, [zeros for zeros, *_ in table], load)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        return cls.read(lambda at, size: data[at : at + size])

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        """From a file written by save_shards."""
        store, at = _store(path)
        file = store.open_input_file(at)
        return cls.read(lambda offset, size: file.read_at(size, offset))


#: Magic, ids, planes; and for each plane its zeros, place, size, and the size of the directory that follows it.
_HEAD, _ENTRY = struct.Struct("<4sQB"), struct.Struct("<QQQQ")


def _store(path: str):
    """File system and path in it of a URI, or of an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def token_shards(docs: DataFrame, path: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, n_docs, n_tokens, doc_ids, ends, data): the ends of the documents' tokens in the shard, and its file."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, parts, ends, total, made = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(parts) if parts else np.zeros(0, np.uint16))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | made], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64()),
                    pa.array([[x.as_py() for x in ids]], pa.list_(ids[0].type)), pa.array([ends], pa.list_(pa.int64())), pa.array([matrix.to_bytes()], pa.binary()),
                ],
                names=["shard", "n_docs", "n_tokens", "doc_ids", "ends", "data"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                tokens = token_ids(text.as_py() or "", path)
                ids.append(doc)
                parts.append(tokens)
                total += len(tokens)
                ends.append(total)
                if total >= shard_tokens:
                    yield close()
                    ids, parts, ends, total, made = [], [], [], 0, made + 1
        if ids:
            yield close()

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        run, f"shard long, n_docs long, n_tokens long, doc_ids array<{kind.simpleString()}>, ends array<long>, data binary"
    )


def save_shards(docs: DataFrame, folder: str, **options) -> DataFrame:
    """(shard, n_docs, n_tokens, doc_ids, ends, path, n_bytes), each shard's file being written to folder, which all executors share.

    A file is named after its shard and moved to its place when it is whole, so a task that runs again writes the same files again.
    """
    shards = token_shards(docs, **options)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root)
        for batch in batches:
            names, sizes = [], []
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                name, raw = f"{shard:016x}.wvm", data.as_py()
                own = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(own) as out:
                    out.write(raw)
                store.move(own, f"{root}/{name}")
                names.append(f"{folder.rstrip('/')}/{name}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names), pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "path", "n_bytes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shards.schema.fields[:-1])
    return shards.mapInArrow(write, f"{kinds}, path string, n_bytes long")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """(shard, doc_id, place) of every occurrence of an id, place being that in the document; from shards' data column."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, ends, data in zip(*batch.columns):
                at = WaveletMatrix.from_bytes(data.as_py()).occurrences(token)
                last = ends.values.to_numpy()
                doc = np.searchsorted(last, at, side="right")
                first = np.concatenate(([0], last))[doc]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard.as_py())), ids.values.take(pa.array(doc)), pa.array(at - first)], names=["shard", "doc_id", "place"])

    return shards.select("shard", "doc_ids", "ends", "data").mapInArrow(run, f"shard long, doc_id {kind}, place long")
