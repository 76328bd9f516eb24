"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over training text.

Spark tasks cut the test items into windows, which are grouped and dealt into blocks. In a block, words
get numbers and a window is a row of ten word numbers. Every task looks up
the numbers of a document's words (0 for words that no test has), hashes the windows with NumPy,
searches the set, and compares the words of each hit with the test's before it counts.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, wide_key

WINDOW = 10
#: About so many bytes of windows are broadcast at once, at so many bytes a window; more are scanned in blocks.
MAX_BLOCK_BYTES, WINDOW_BYTES = 32 << 20, 64
#: A window of more items than this is dealt to several rows of about so many, which may lie in different blocks; bytes that an item beyond the first counts for.
MOST_ITEMS, ITEM_BYTES = 1_000, 16
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, k struct<a:bigint,b:bigint>, row long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class _Words(dict):
    """Unknown words are number 0."""

    def __missing__(self, key: bytes) -> int:
        return 0


class Windows:
    """A block of distinct test windows, by length: sorted hashes, word numbers and places in the list of owners."""

    def __init__(self, grams: list[bytes], items: list[list[str]]):
        self.number = _Words()
        self.owners: list[list[str]] = []
        places: dict[tuple[str, ...], int] = {}
        by_size: dict[int, tuple[array, array]] = {}
        for gram, own in zip(grams, items, strict=True):
            words = gram.split(b" ")
            ids, owner = by_size.setdefault(len(words), (array("I"), array("I")))
            ids.extend(self.number.setdefault(w, len(self.number) + 1) for w in words)
            place = places.setdefault(tuple(own), len(places))
            if place == len(self.owners):
                self.owners.append(own)
            owner.append(place)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted(by_size):
            grid, owner = (np.frombuffer(x, np.uint32) for x in by_size[size])
            keys = _hash(grid.astype(np.uint64), size)[::size]
            order = np.argsort(keys, kind="stable")
            self.by_length[size] = (keys[order], grid.reshape(-1, size)[order], owner[order])

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items with occurring windows."""
        n = len(words)
        hit, items = np.zeros(n + 1, np.int64), set()
        ids = np.fromiter(map(self.number.__getitem__, words), np.uint64, n)
        strange = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (keys, grid, owner) in self.by_length.items():
            if size > n:
                continue
            at = np.flatnonzero(strange[size:] == strange[:-size])
            if not at.size:
                continue
            h = _hash(ids, size)[at]
            k = np.searchsorted(keys, h)
            same = keys[np.minimum(k, keys.size - 1)] == h
            for p, i in zip(at[same].tolist(), k[same].tolist(), strict=True):
                key = keys[i]
                while i < keys.size and keys[i] == key:
                    if (grid[i] == ids[p : p + size]).all():
                        hit[p] += 1
                        hit[p + size] -= 1
                        items.update(self.owners[owner[i]])
                    i += 1
        return np.cumsum(hit[:n]) > 0, items


def _hash(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` numbers."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(ids) - size + 1, np.uint64)
        for i in range(size):
            out = (out ^ ids[i : len(ids) - size + 1 + i]) * _MULTIPLY
            out ^= out >> np.uint64(29)
    return out


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _scanner(blob):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = blob.value  # a worker reads it once
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                hit, items = windows.scan(words)
                rows.append((len(words), int(hit.sum()), sorted(items), _runs(hit) if items else []))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), b.column("row"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], span)],
                names=["doc_id", "k", "row", "n_words", "n_hit", "items", "spans"],
            )

    return run


def _grams(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                size = min(width, len(words))
                grams = list({b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}) if size else []
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array([item] * len(grams), pa.string())], names=["gram", "item"])

    return run


def _windows(benchmark: DataFrame, item_col: str, width: int, most_items: int) -> DataFrame:
    """(gram, items): the distinct windows; one that very many items share has several rows, each with some of them."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("None")).alias("item"), F.col("text").cast("string").alias("text"))
    pairs = materialize(items.mapInArrow(_grams(width), "gram binary, item string"), "grams")
    crowds = pairs.groupBy("gram").agg(F.ceil(F.count("*") / most_items).alias("parts")).filter("parts > 1")
    dealt = pairs.join(crowds, "gram", "left").withColumn("part", F.pmod(F.xxhash64("item"), F.coalesce("parts", F.lit(1))))
    return materialize(dealt.groupBy("gram", "part").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")


def _blocks(benchmark: DataFrame, item_col: str, width: int, max_bytes: int, most_items: int = MOST_ITEMS) -> Iterator[tuple[Windows, int]]:
    """The windows in blocks of about ``max_bytes``, and how many blocks there are; an empty one if there are no windows.

    The driver makes a block when it is asked for the next one, so it need not hold two.
    """
    found = _windows(benchmark, item_col, width, most_items)
    size = found.agg(F.sum(F.lit(WINDOW_BYTES) + F.lit(ITEM_BYTES) * (F.size("items") - 1))).first()[0] or 0
    blocks = max(1, -(-size // max(WINDOW_BYTES, max_bytes)))
    for i in range(blocks):
        t = found.filter(F.pmod(F.xxhash64("gram", "part"), F.lit(blocks)) == i).toArrow()
        if t.num_rows or not i:
            yield Windows(t.column("gram").to_pylist(), t.column("items").to_pylist()), blocks


def _united(spans: Column) -> Column:
    """Sorted spans, those that overlap or touch made one."""
    kind = "array<struct<start:int,end:int>>"

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), longer)
        return F.when((F.size(out) > 0) & (last["end"] >= s["start"]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def _scanned(docs: DataFrame, benchmark: DataFrame, item_col: str, width: int, max_block: int) -> DataFrame:
    """The rows of ``scan`` with their keys.

    Of several blocks one is broadcast, its scan's hits are written, and it is given up before the next.
    """
    sent = docs.sparkSession.sparkContext.broadcast
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), wide_key(docs).alias("k"))
    parts: list[DataFrame] = []
    for windows, n in _blocks(benchmark, item_col, width, max_block):
        blob = sent(windows)
        if n == 1:
            return plain.withColumn("row", F.lit(0).cast("long")).mapInArrow(_scanner(blob), RESULT).drop("row")
        if not parts:
            rows = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "rows")  # the same number in every block's scan
        hits = rows.mapInArrow(_scanner(blob), RESULT)
        parts.append(materialize(hits.filter("n_hit > 0") if parts else hits, "hits"))  # the first has a row for each document
        blob.destroy()
    both = functools.reduce(DataFrame.unionByName, parts)
    met = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("k").alias("k"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        _united(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return met.select("doc_id", "k", "n_words", n_hit.alias("n_hit"), "items", "spans")


def scan(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", width: int = WINDOW, max_block: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, the items (sorted) whose windows occur, and the hit word spans.

    A null or empty text has no words and no hits; so has a null or empty item. An item of fewer than
    ``width`` words is one window. Repeated rows are scanned each; an empty benchmark hits nothing.
    Other columns are not read. Test windows beyond about ``max_block`` bytes are scanned block by block, one
    block being held at a time, and the blocks' hits of a row are joined, so that what is broadcast stays bounded; the
    results are the same. A window that very many items share is dealt to several blocks.
    """
    return _scanned(docs, benchmark, item_col, width, max_block).drop("k")


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s rows."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", width: int = WINDOW, max_block: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a test window, with their columns; rows of repeated or null ids are told apart."""
    bad = _scanned(docs, benchmark, item_col, width, max_block).filter("n_hit > 0").select(F.col("k").alias("__bad"))
    return docs.join(bad, wide_key(docs) == F.col("__bad"), "left_anti")
