"""Token ids as one concatenated array with Elias-Fano encoded document boundaries.

A store is a folder of blocks. A block holds the ids of successive documents in ascending id order,
and two Elias-Fano sequences: where each document begins, and the documents' own ids. A sequence of n
values up to u takes about n * (2 + log2(u / n)) bits; ``select`` finds any value from a small table
of sampled positions. Offsets are therefore read from the blocks, never from 64-bit tables.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_text, new_path

END_ID = 2
#: A block ends at the first document that takes it beyond so many ids.
BLOCK_IDS = 1 << 20
#: Words whose ids a worker remembers, and bytes of such a word.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 64
MAGIC = b"EFTS\x01"
BLOCKS = "part int, block int, start long, n_docs long, n_ids long, content binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class EliasFano:
    """A non-decreasing sequence of non-negative integers.

    Each value's low bits are stored plainly; its high part h, at index i, sets bit h + i of a bitmap.
    """

    SAMPLE = 64

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._samples: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low.tobytes(), np.packbits(bits, bitorder="little").tobytes())

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", raw, at)
        at += 25
        return cls(n, low_bits, bytes(raw[at : at + a]), bytes(raw[at + a : at + a + b])), at + a + b

    def _low(self, i: int) -> int:
        bit = i * self.low_bits
        end = bit + self.low_bits
        return (int.from_bytes(self.low[bit // 8 : -(-end // 8)], "little") >> (bit % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i, by a jump to the sampled byte before it and a scan of a few bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        raw = np.frombuffer(self.high, np.uint8)
        if self._samples is None:
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(raw))))
            self._samples = np.searchsorted(before, np.arange(0, self.n, self.SAMPLE), side="right") - 1
            self._seen = before[self._samples]
        k = i // self.SAMPLE
        byte, seen = int(self._samples[k]), int(self._seen[k])
        while seen + (c := int(self.high[byte]).bit_count()) <= i:
            seen += c
            byte += 1
        bits = self.high[byte]
        for _ in range(i - seen):
            bits &= bits - 1
        one = byte * 8 + (bits & -bits).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low(i)

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        low = (bits.reshape(self.n, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64) if self.low_bits else np.uint64(0)
        return (high << np.uint64(self.low_bits)) | low


def pack_block(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A block: header, boundaries (one more than documents), document ids, id array.

    Null document ids come first, in ascending order; the others are stored from the first one on.
    """
    sizes = np.array([len(x) // width for x in ids], np.uint64)
    bounds = EliasFano.encode(np.concatenate((np.zeros(1, np.uint64), np.cumsum(sizes))))
    nulls = sum(x is None for x in doc_ids)
    real = np.array(doc_ids[nulls:], np.int64)
    names = EliasFano.encode((real - real[0]).view(np.uint64) if len(real) else np.zeros(0, np.uint64))
    head = MAGIC + struct.pack("<BQQq", width, len(doc_ids), nulls, int(real[0]) if len(real) else 0)
    return head + bounds.to_bytes() + names.to_bytes() + b"".join(ids)


class Block:
    """A block that was read back."""

    def __init__(self, content: bytes):
        if content[:5] != MAGIC:
            raise ValueError("not a block of token ids")
        raw = memoryview(content)
        self.width, self.n_docs, self.nulls, self.first = struct.unpack_from("<BQQq", raw, 5)
        self.bounds, at = EliasFano.from_bytes(raw, 30)
        self.names, at = EliasFano.from_bytes(raw, at)
        self.ids = np.frombuffer(raw[at:], f"<u{self.width}")

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.decode().view(np.int64) + self.first).tolist()

    def document(self, i: int) -> np.ndarray:
        """The ids of document i of this block, found by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_ENDING = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,]+)")


class WordIds(dict):
    """White-space separated words to the bytes of their ids.

    The tokenizer drops white space and never looks past it, so a text's ids are its words' ids in
    turn. A word of letters only is one unit of the tokenizer's model, so the model can be asked
    directly; a word that differs in the case of A-Z, or by a full stop or comma at its end, reuses
    what is known. Anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.shown = {b: chr(b) if b in printable else chr(next(other)) for b in range(256)}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if _PLAIN.fullmatch(word):
            found = self.pack([t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.shown))])
        elif m := _ENDING.fullmatch(word):
            found = self[m[1]] + self[m[2]]
        elif (low := word.lower()) != word and b"<|" not in word and b"\xcc" not in word and b"\xcd" not in word:
            found = self[low]
        else:
            found = self.pack(self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str | None, end: bytes) -> bytes:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        return b"".join(map(self.__getitem__, words)) + end


_KNOWN: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """One dictionary per vocabulary and worker, kept over its tasks."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return _KNOWN[path]


def _writer(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = _word_ids(path)
        end = words.pack([end_id])
        names: list[int | None] = []
        ids: list[bytes] = []
        block = start = size = 0

        def row() -> pa.RecordBatch:
            cols = [[part], [block], [start], [len(ids)], [size], [pack_block(names, ids, words.width)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "block", "start", "n_docs", "n_ids", "content"])

        for b in batches:
            for name, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                names.append(name)
                ids.append(words.encode(text.as_py(), end))
                size += len(ids[-1]) // words.width
                if size >= block_ids:
                    yield row()
                    names, ids, block, start, size = [], [], block + 1, start + size, 0
        if ids:
            yield row()

    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text, appends ``end_id``, and writes the store to ``path``.

    The documents are dealt into id ranges and sorted there, so part p holds smaller ids than part
    p + 1. A null or empty text is the end id alone. Null document ids come first; repeated ids keep
    their rows, in no fixed order among themselves. Other columns are not read. An empty table gives an
    empty store. A document longer than a block makes a block of its own.
    """
    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_writer(vocabulary or default_vocabulary(), end_id, block_ids), BLOCKS).write.parquet(path)


def _reader(before):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                block = Block(r["content"])
                bounds = np.array([block.bounds.select(i) for i in range(block.n_docs + 1)], np.int64)
                base = before.value[r["part"]] + r["start"]
                crc = [zlib.crc32(block.document(i).astype("<u4").tobytes()) for i in range(block.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids(), pa.int64()), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the blocks of a store.

    A part's first offset is the sum of the parts before it: one number per part, whatever the corpus.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sums):
        before[p] = total
        total += sums[p]
    return blocks.select("part", "start", "content").mapInArrow(_reader(spark.sparkContext.broadcast(before)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` to a fresh store in the shared folder and reads its index back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, **options)
    return read_index(docs.sparkSession, path)
