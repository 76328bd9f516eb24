"""Byte-level BPE as folds of ranked merges, in Spark's higher-order functions.

Spark splits every text into pieces; a task keeps each distinct piece of a block of documents once, as
a byte array, and the documents as lists of piece numbers. This step is narrow: nothing is shuffled,
and a very frequent word costs one entry. Spark then folds the ranked merges over the byte arrays
against a constant rank map and concatenates the binary pieces of the ids again; the ids and bytes of
a document are gathered by its piece numbers. Rows of a partition keep their order throughout, so
the pieces of a block precede its documents.

Pieces that are frequent in a bounded sample are folded first, once for all tasks, and sent to them: a
block then folds only what is not among them. This changes no result. A fold takes as many
steps as a piece has bytes, each over the whole piece; pieces of more than ``LONG`` bytes, which
natural text hardly has, are merged from a heap instead.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_text, materialize, small_batches

#: Distinct pieces that one row carries through the fold.
CHUNK = 512
#: Rows that Python takes of an Arrow batch at once.
SLICE = 500
#: A block ends with the slice of documents that takes it beyond so many pieces: a task holds one block.
BLOCK_PIECES = 2_000_000
#: Bytes of text, taken from all partitions alike, whose pieces are folded for all tasks, and such pieces at most.
SAMPLE_BYTES, SAMPLE_PIECES = 128 << 20, 500_000
#: Rows of an Arrow batch at most, as a document has many pieces.
BATCH_ROWS = 1_000
#: Pieces of more bytes are not folded: the fold is quadratic.
LONG = 1_024
#: White space by Unicode's property, for regular expressions whose \\s is ASCII's.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Piece to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) to the merged id, for every cut of every piece into two pieces.

    The rank of a merge is the id it makes, so the lowest merged id is the first merge.
    """
    out = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def _is_prime(n: int) -> bool:
    return all(n % k for k in range(2, int(n**0.5) + 1))


def _places(keys: dict[int, int], bits: int) -> tuple[list[int], list[int], list[int]]:
    """The rank map as two arrays with one possible place for a key in each (cuckoo hashing).

    A key's place is its remainder by the array's length, a prime. Returns both lengths and arrays of
    packed (quotient, rank), which are shorter than keys in the plan; Spark reads two places per pair, however
    many pairs there are.
    """
    size = max(11, len(keys))
    while True:
        primes: list[int] = []
        n = size | 1
        while len(primes) < 2:
            if _is_prime(n):
                primes.append(n)
            n += 2
        tables: list[list[int | None]] = [[None] * n for n in primes]
        for key in keys:
            side, moves = 0, 0
            while moves < 500:
                at = key % primes[side]
                key, tables[side][at] = tables[side][at], key
                if key is None:
                    break
                side, moves = 1 - side, moves + 1
            else:
                break
        else:
            packed = [[-1 if k is None else k // n << bits | keys[k] for k in t] for n, t in zip(primes, tables, strict=True)]
            return primes, *packed
        size = size * 5 // 4


def _constant(spark: SparkSession, values: list, kind: pa.DataType) -> Column:
    """An array as a constant of every plan that uses it: the one value of a one-row table, so that plans don't spell it out."""
    return spark.createDataFrame(pa.table({"value": pa.array([values], pa.list_(kind))})).scalar()


def _if(condition: Column, yes: Column, no: Column) -> Column:
    return F.call_function("if", condition, yes, no)


def _bound(value: Column, same_type: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; ``same_type`` has the result's type.

    A fold over an array of one: taking an element of a transformed array would derive the whole
    expression's type again for every row.
    """
    return F.aggregate(F.array(value), same_type, lambda _, x: use(x))


class Folder:
    """The columns of encoding and decoding for one vocabulary.

    While it is folded, a piece is an array of packed numbers, one per id: the rank of its merge with the
    next id (all ones: none), the byte where it begins, the id. So the least number of the array
    is the next merge, the leftmost of the lowest rank. Each table stands in a plan once, as a constant
    that a lambda binds for all pieces of a row.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        size = max(ranks.values()) + 1
        self.bits = size.bit_length()
        self.none = (1 << self.bits) - 1
        #: Where the rank begins; between it and the id are the bits of the place.
        self.top = 63 - self.bits
        if missing or self.none in ranks.values() or self.bits > 20:
            raise ValueError("every byte needs an id, and ids must be below a million")
        merges = {left << self.bits | right: rank for (left, right), rank in merge_table(ranks).items()}
        self.primes, *tables = _places(merges, self.bits)
        self.constants = [_constant(spark, t, pa.int64()).alias(f"__table{i}") for i, t in enumerate(tables)]
        self.tables = [F.col(f"__table{i}") for i in range(len(tables))]
        self.constants.append(_constant(spark, [ranks[bytes([b])] for b in range(256)], pa.int64()).alias("__single"))
        self.single = F.col("__single")
        by_id: list[bytes | None] = [None] * size
        for piece, rank in ranks.items():
            by_id[rank] = piece
        self.constants.append(_constant(spark, by_id, pa.binary()).alias("__pieces"))
        self.pieces = F.col("__pieces")

    def _rank(self, key: Column, tables: list[Column]) -> Column:
        """The rank of the merge of two ids (left, then right in the lower bits), in its place; all ones without one."""
        rank = F.lit(self.none).cast("long")
        for t, p in reversed(list(zip(tables, self.primes, strict=True))):
            e = F.get(t, (key % p).cast("int"))
            rank = _if(F.shiftright(e, self.bits) == F.call_function("div", key, F.lit(p)), e.bitwiseAND(self.none), rank)
        return F.shiftleft(rank, self.top)

    def ids(self, words: Column) -> Column:
        """The ids of each piece of an array of pieces, given as arrays of their bytes (0 to 255)."""
        first, second = self.tables
        out = F.array().cast("array<array<int>>")
        return _bound(first, out, lambda a: _bound(second, out, lambda b: _bound(self.single, out, lambda c: F.transform(words, lambda w: _if(F.get(w, 0) < 0, F.transform(w, lambda x: -1 - x), self._folded(w, [a, b], c))))))

    def _folded(self, codes: Column, tables: list[Column], single: Column) -> Column:
        """A step merges the leftmost pair of the lowest rank and looks up the two pairs that it makes."""
        top, bits, none = self.top, self.bits, self.none
        low_mask = (1 << top) - 1
        place = low_mask - none  # the mask of the place's bits
        no_id = F.lit(none).cast("long")

        def pair(left: Column, right: Column) -> Column:
            return F.shiftleft(left, bits).bitwiseOR(right)

        def rank(key: Column) -> Column:
            return self._rank(key, tables)

        def step(s: Column, _: Column) -> Column:
            def merged(m: Column, at: Column) -> Column:
                low = F.shiftright(m, top)
                new = m.bitwiseAND(place).bitwiseOR(low)
                with_next = pair(low, F.coalesce(F.get(s, at + 1).bitwiseAND(none), no_id))
                before = F.get(s, at - 2)
                with_left = pair(before.bitwiseAND(none), low)
                two = F.zip_with(F.array(with_left, with_next), F.array(before.bitwiseAND(low_mask), new), lambda k, e: rank(k).bitwiseOR(e))
                one = F.transform(F.array(with_next), lambda k: rank(k).bitwiseOR(new))
                rest = F.slice(s, at + 2, F.size(s))
                return _if(at > 1, F.concat(F.slice(s, 1, at - 2), two, rest), F.concat(one, rest))

            def least(m: Column) -> Column:
                # The element's number: array_position leaves its loop by an exception, which costs more.
                upto = _bound(m.bitwiseAND(place), s, lambda p: F.filter(s, lambda x: x.bitwiseAND(place) <= p))
                return _if(m >= F.lit(none << top), s, _bound(F.size(upto), s, lambda at: merged(m, at)))

            return _bound(F.array_min(s), s, least)

        no_ids = F.array().cast("array<bigint>")
        start = F.transform(codes, lambda b: F.get(single, b))
        keys = _bound(start, no_ids, lambda ids: F.transform(ids, lambda x, i: pair(x, F.coalesce(F.get(ids, i + 1), no_id))))
        packed = F.transform(keys, lambda k, i: rank(k).bitwiseOR(F.shiftleft(i.cast("long"), bits)).bitwiseOR(F.shiftright(k, bits)))
        folded = F.aggregate(F.slice(codes, 2, F.size(codes)), packed, step)
        return F.transform(folded, lambda x: x.bitwiseAND(none).cast("int"))

    def decoded(self, ids: Column) -> Column:
        """The bytes of each array of ids: their binary pieces, concatenated."""
        out = F.array().cast("array<binary>")

        def joined(w: Column, pieces: Column) -> Column:
            return F.aggregate(w, F.lit(b""), lambda acc, i: F.concat(acc, F.get(pieces, i)))

        def one(w: Column, pieces: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(1), F.size(w), F.lit(LONG)), lambda k: joined(F.slice(w, k, LONG), pieces))
            return _if(F.size(w) <= LONG, joined(w, pieces), F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x)))

        return _bound(self.pieces, out, lambda p: F.transform(ids, lambda w: one(w, p)))


def heap_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long piece: the leftmost pair of the lowest rank comes from a heap, so n bytes take n log n steps."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    start = list(range(-1, n))  # of the part before the one that begins here
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (r := ranks.get(piece[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i))

    while heap:
        rank, i = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or ranks.get(piece[i : end[middle]]) != rank:
            continue  # one of the two is another part by now
        end[i], end[middle] = end[middle], 0
        start[end[i]] = i
        offer(i)
        offer(start[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _gather(values: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that ``numbers`` name, one after the other."""
    starts = ends[numbers].astype(np.int64)
    sizes = ends[numbers + 1] - starts
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if len(numbers) else np.zeros(0, np.int64)
    return values[shift + np.arange(total)]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), _MIX, np.uint64))), dtype=np.uint64)


def _hashes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; only candidates for a comparison."""
    sizes = np.diff(ends)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], sizes)
    h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[place], ends[:-1])
    return (h ^ (h >> np.uint64(29))) * _MIX


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls or empty values, one after the other, and where each one ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


class _Known:
    """Pieces that are folded already: their ids, and the bytes that these decode to, ordered by the bytes' hash.

    All is one buffer, so that a worker reads it without a further copy.
    """

    KINDS = (np.uint64, np.uint32, np.int32, np.int32, np.uint8)

    def __init__(self, buffer: bytes):
        sizes = np.frombuffer(buffer, np.int64, len(self.KINDS))
        at, parts = sizes.nbytes, []
        for n, kind in zip(sizes.tolist(), self.KINDS, strict=True):
            parts.append(np.frombuffer(buffer, kind, n, at))
            at += parts[-1].nbytes
        self.hashes, ids, id_ends, ends, raw = parts
        self.values, self.ends = (ids, raw), (id_ends, ends)

    @classmethod
    def pack(cls, ids: pa.Array, decoded: pa.Array) -> bytes:
        raw, ends = _runs(decoded)
        h = _hashes(raw, ends)
        order = np.argsort(h, kind="stable")
        order = order[np.concatenate((h[order][1:] != h[order][:-1], [True]))] if len(h) else order
        flat, sizes = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False)
        id_ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        new_ends = (np.concatenate(([0], np.cumsum(np.diff(e)[order]))) for e in (id_ends, ends))
        parts = [x.astype(k) for x, k in zip((h[order], _gather(flat, id_ends, order), *new_ends, _gather(raw, ends, order)), cls.KINDS, strict=True)]
        return b"".join(x.tobytes() for x in (np.array([len(x) for x in parts], np.int64), *parts))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece here, or -1; all bytes are compared."""
        raw, ends = _runs(pieces)
        if not len(self) or not len(pieces):
            return np.full(len(pieces), -1, np.int64)
        h = _hashes(raw, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        sizes = np.diff(ends)
        met = np.flatnonzero((self.hashes[at] == h) & (np.diff(self.ends[1])[at] == sizes))
        found = np.full(len(pieces), -1, np.int64)
        if len(met):
            same = _gather(raw, ends, met) == _gather(self.values[1], self.ends[1], at[met])
            equal = np.logical_and.reduceat(same, np.concatenate(([0], np.cumsum(sizes[met])[:-1])))
            found[met[equal]] = at[met[equal]]
        return found


def _words_rows(words: list[bytes], ranks) -> Iterator[pa.Array]:
    """Columns of rows of ``CHUNK`` pieces as arrays of bytes. A long piece comes merged, as its ids below zero (-1 for 0)."""
    for a in range(0, len(words), CHUNK * 16):
        each = [np.frombuffer(w, np.uint8).astype(np.int32) if len(w) <= LONG else -1 - np.array(heap_ids(w, ranks.value), np.int32) for w in words[a : a + CHUNK * 16]]
        ends = np.concatenate(([0], np.cumsum([len(w) for w in each]))).astype(np.int32)
        cuts = np.minimum(np.arange(0, len(each) + CHUNK, CHUNK), len(each)).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(cuts), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each))))


_BLOCK = "doc_id long, words array<array<int>>, numbers binary"


class _Block:
    """The distinct pieces of some documents that are not known, and each document's piece numbers."""

    def __init__(self, known: _Known):
        self.known, self.own = known, {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, part: pa.RecordBatch) -> None:
        lists = part.column("pieces")
        coded = lists.flatten().cast(pa.binary()).dictionary_encode()
        named = self.known.find(coded.dictionary)
        strange = np.flatnonzero(named < 0)
        own, base = self.own, len(self.known)
        named[strange] = np.fromiter((own.setdefault(w, len(own)) for w in coded.dictionary.take(pa.array(strange)).to_pylist()), np.int64, len(strange)) + base
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        numbers = named.astype(np.int32)[coded.indices.to_numpy(zero_copy_only=False)] if len(named) else np.zeros(0, np.int32)
        # Copies, so that the batch's memory is free.
        self.parts.append((pa.array(part.column("doc_id").to_pylist(), pa.int64()), numbers, ends))
        self.size += len(numbers)

    def rows(self, ranks) -> Iterator[pa.RecordBatch]:
        words_type, number_type = pa.list_(pa.list_(pa.int32())), pa.binary()
        words = list(self.own)
        self.own = {}
        for rows in _words_rows(words, ranks):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), rows, pa.nulls(len(rows), number_type)], names=["doc_id", "words", "numbers"])
        self.parts.reverse()
        while self.parts:
            names, numbers, ends = self.parts.pop()
            each = [numbers[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(each), words_type), pa.array(each, number_type)], names=["doc_id", "words", "numbers"])


def _blocks(sent, ranks):
    """Rows of distinct pieces as byte arrays, then a row of piece numbers per document, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(sent.value)
        block = _Block(known)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                block.add(b.slice(at, SLICE))
                if block.size >= BLOCK_PIECES:
                    yield from block.rows(ranks)
                    block = _Block(known)
        if block.parts:
            yield from block.rows(ranks)

    return run


class _Folded:
    """What the pieces of a block became, behind the known ones: values and where each piece's run ends."""

    def __init__(self, known: _Known):
        self.open, self.known, self.values, self.sizes = True, known, ([], []), ([], [])

    def add(self, batch: pa.RecordBatch) -> None:
        inner, texts = batch.column("ids").flatten(), batch.column("decoded").flatten()
        self.values[0].append(inner.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
        self.sizes[0].append(inner.value_lengths().to_numpy(zero_copy_only=False))
        self.values[1].append(np.frombuffer(b"".join(texts.to_pylist()), np.uint8))
        self.sizes[1].append(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))

    def close(self) -> None:
        if self.open:
            self.open = False
            kinds = zip(self.values, self.sizes, self.known.values, self.known.ends, strict=True)
            joined = [(np.concatenate([k, *v]), np.concatenate((e, e[-1] + np.cumsum(np.concatenate([*n, np.zeros(0, np.int32)]), dtype=np.int32)))) for v, n, k, e in kinds]
            self.values, self.sizes = zip(*joined, strict=True)

    def of(self, numbers: bytes) -> tuple[bytes, bytes]:
        at = np.frombuffer(numbers, "<i4").astype(np.int64)
        return tuple(_gather(v, s, at).tobytes() for v, s in zip(self.values, self.sizes, strict=True))


def _documents(sent):
    """Documents' ids and decoded bytes, from the piece rows before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(sent.value)
        block = _Folded(known)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                is_document = b.column("numbers").is_valid().to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(is_document)) + 1).tolist(), b.num_rows]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    part = b.slice(x, y - x)
                    if not is_document[x]:
                        block = block if block.open else _Folded(known)
                        block.add(part)
                        continue
                    block.close()
                    pairs = [block.of(numbers) for numbers in part.column("numbers").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([i for i, _ in pairs], pa.binary()), pa.array([d for _, d in pairs], pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


@lru_cache(maxsize=8)
def library_class(name: str) -> frozenset[int]:
    """The code points of a Unicode class such as ``\\p{L}``, as the library that the ids must equal has it."""
    import tiktoken

    single = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    found = bytes(single.encode_ordinary("".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    return frozenset(map(ord, found.decode()))


def _ranges(points: frozenset[int]) -> str:
    """Code points as ranges of a regular expression's class."""
    found: list[list[int]] = []
    for p in sorted(points):
        if found and found[-1][1] == p - 1:
            found[-1][1] = p
        else:
            found.append([p, p])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in found)


_OWN: dict[str, str] = {}


def _class_for(spark: SparkSession, name: str) -> str:
    """The inside of a class that matches what the library's ``name`` does: Spark's own class, whose Unicode may be older, and what that lacks."""
    if name not in _OWN:
        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        row = spark.createDataFrame([("".join(map(chr, points)),)], "text string")
        ours = frozenset(map(ord, row.select(F.regexp_replace("text", f"[^{name}]", "")).first()[0]))
        theirs = library_class(name)
        missing = theirs - ours
        # Behind a guard, as a class is tried range by range: most characters then cost one comparison more.
        own = f"[\\x{{{min(missing):x}}}-\\x{{10ffff}}&&[{_ranges(missing)}]]" if missing else ""
        _OWN[name] = name + own if ours <= theirs else _ranges(theirs)
    return _OWN[name]


def split_pattern(spark: SparkSession, pattern: str) -> str:
    """``pattern`` for Spark's regular expressions: white space and Unicode's classes as the library has them, inside brackets and out."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        found = WHITE if part in (r"\s", r"\S") else _class_for(spark, part) if part.startswith(r"\p") else None
        if found is None:
            inside = part == "[" or inside and part != "]"
            out.append(part)
        elif part == r"\S":
            out.append(f"[^{found}]")  # inside brackets, a union
        else:
            out.append(found if inside else f"[{found}]")
    return "".join(out)


def _chunks(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in _words_rows(b.column("piece").cast(pa.binary()).to_pylist(), ranks):
                yield pa.RecordBatch.from_arrays([rows], names=["words"])

    return run


def _frequent(texts: DataFrame, pieces: Column, folder: Folder, ranks) -> bytes:
    """The pieces of a sample, as many of the most frequent as are allowed, folded (see ``_Known``)."""
    sc = texts.sparkSession.sparkContext
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    some = texts.sample(SAMPLE_BYTES / size, seed=1) if size > SAMPLE_BYTES else texts
    counted = some.select(F.explode(F.array_distinct(pieces)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    counted = materialize(counted.filter(F.octet_length("piece") <= LONG), "pieces")
    # How many pieces have each number of documents: the sample bounds the rows.
    steps = counted.groupBy("n").agg(F.count("*").alias("pieces")).orderBy(F.desc("n")).collect()
    least, total = None, 0
    for r in steps:
        if total + r["pieces"] > SAMPLE_PIECES:
            break
        least, total = r["n"], total + r["pieces"]
    if least is None:
        return _Known.pack(pa.array([], pa.list_(pa.int32())), pa.array([], pa.binary()))
    dealt = counted.filter(F.col("n") >= least).select("piece").repartition(2 * sc.defaultParallelism + total // 20_000)
    # Written first, as a plan with an exchange is described anew, tables included, with every stage that ends.
    chunks = materialize(dealt.mapInArrow(_chunks(ranks), "words array<array<int>>"), "chunks")
    words = chunks.select("words", *folder.constants).select(folder.ids(F.col("words")).alias("ids"), "__pieces")
    folded = words.select("ids", folder.decoded(F.col("ids")).alias("decoded")).toArrow()
    ids, decoded = (pa.concat_arrays([x.flatten() for x in folded.column(c).chunks]) for c in ("ids", "decoded"))
    return _Known.pack(ids, decoded)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian 32-bit numbers, and the bytes they decode to.

    A null or empty text has no ids. Repeated rows are encoded each; an empty table gives an empty result;
    other columns are not read. The sample only saves work: what it holds changes no result. Arrow batches of
    the session are limited to ``BATCH_ROWS`` rows.
    """
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession, BATCH_ROWS)
    ranks = load_ranks(ranks_path or default_ranks())
    folder, sent_ranks = Folder(docs.sparkSession, ranks), sc.broadcast(ranks)
    texts = id_text(docs)
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(split_pattern(docs.sparkSession, pattern or default_pattern())), F.lit(0))
    sent = sc.broadcast(_frequent(texts, found, folder, sent_ranks))
    blocks = texts.select("doc_id", found.alias("pieces")).mapInArrow(_blocks(sent, sent_ranks), _BLOCK)
    words = blocks.select("doc_id", "numbers", "words", *folder.constants).select("doc_id", "numbers", folder.ids(F.col("words")).alias("ids"), "__pieces")
    both = words.select("doc_id", "numbers", "ids", folder.decoded(F.col("ids")).alias("decoded"))
    return both.mapInArrow(_documents(sent), "doc_id long, ids binary, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """The digest columns of ``encode``'s rows."""
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
