"""Removal of repeated byte strings by sorting suffixes deep-shallow.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Of each such
string (window), the position with the least hash of ``GRAM`` bytes is its anchor; it depends on the
window's bytes alone, so equal windows have equal anchors at equal offsets, and only the suffixes at
anchors need sorting: about one in 170. Anchors whose gram occurs once in the corpus drop out. The
others meet by gram with the bytes around them: their suffixes, and the reversed prefixes before
them, are sorted by multikey quicksort to a shallow depth and by blind tries beyond it. Sorted
neighbours give the longest common extensions to both sides, and so exactly the windows that occur
again.

The same sort also tells which strings of ``PASSAGE`` bytes occur again. Nothing is removed for them; their
bytes are counted, as a passage of some fifty words is often shorter than ``LENGTH``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Bytes of a string that is removed where it repeats, and of one that only counts.
LENGTH, PASSAGE = 400, 250
GRAM = 64
#: Depth to which multikey quicksort sorts; what is equal so far goes to a blind trie.
SHALLOW = GRAM + 32
#: Anchors of one gram that a task sorts; those of a more frequent gram are counted window by window. Grams above it at most.
GROUP, HOT_GRAMS = 20_000, 200_000
#: Contexts of a group up to which all pairs are looked at.
PAIRS = 256
#: Bits of the filter of grams that occur twice or more: its size is fixed, whatever the corpus.
FILTER_BITS = 1 << 26
#: Rows of contexts that a task gathers before it sends them.
OUT_ROWS = 20_000
#: Positions that are searched for anchors at once.
SLICE = 1 << 20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each position, by doubling the length from 8."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(raw) - 7, np.uint64)
        for i in range(8):
            h = (h << np.uint64(8)) | raw[i : len(raw) - 7 + i]
        size = 8
        while size < GRAM:
            h = (h[:-size] ^ (h[:-size] >> np.uint64(32))) * _C1 + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
        return h * _C2


def _sliding(key: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` successive ones."""
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (width - size)], key[width - size :]) if width > size else key


def _window_anchors(h: np.ndarray, length: int) -> np.ndarray:
    """The anchor of every window of ``length`` bytes; of equal hashes the leftmost."""
    out = [np.zeros(0, np.int64)]
    width = length - GRAM + 1
    for a in range(0, len(h) - width + 1, SLICE - width + 1):
        part = h[a : a + SLICE]
        key = (part & ~np.uint64(SLICE - 1)) | np.arange(len(part), dtype=np.uint64)
        out.append((_sliding(key, width) & np.uint64(SLICE - 1)).astype(np.int64) + a)
    return np.concatenate(out)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, bool]]]:
    """(anchor positions, their gram hashes, which are anchors of ``LENGTH`` bytes, runs known to repeat) of one text.

    The anchors of windows of ``LENGTH`` bytes are also those of the shorter windows of ``PASSAGE`` bytes around
    them. In a run of period q, every window but the first q equals the one q before it. Those windows are
    known to repeat and need no anchors, which spares a text like "ha ha ha" an anchor per period. A run
    is (start, end, whether it holds ``LENGTH`` bytes).
    """
    n = len(raw)
    if n < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), []
    h = gram_hashes(raw)
    every = {length: _window_anchors(h, length) for length in (PASSAGE, LENGTH)}
    found = {length: np.unique(x) for length, x in every.items()}
    known: list[tuple[int, int, bool]] = []
    if len(found[PASSAGE]) > 8 + 4 * n // (PASSAGE - GRAM + 1):
        gaps = np.diff(found[PASSAGE])
        same = h[found[PASSAGE][1:]] == h[found[PASSAGE][:-1]]
        spare = {length: np.zeros(len(x), bool) for length, x in every.items()}
        for q in np.unique(gaps[same]).tolist():
            equal = raw[q:] == raw[:-q]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], equal.astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                for length, x in spare.items():
                    if b - a >= length:  # bytes a .. b + q have period q
                        known.append((a, b + q, length == LENGTH))
                        x[a + q : b + q - length + 1] = True
        found = {length: np.unique(x[~spare[length]]) for length, x in every.items()}
    at = np.union1d(found[PASSAGE], found[LENGTH])
    return at, h[at], np.isin(at, found[LENGTH]), known


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _blind_trie(strings: list[bytes], rows: list[int], depth: int) -> list[int]:
    """The rows in order: a trie that keeps, per branching, only its depth and the next bytes.

    A string finds its place blindly, by the bytes at the branchings; one comparison with the leaf that
    it reaches tells how deep the two agree, which is where it branches off.
    """
    root: list = [rows[0]]  # a leaf: rows of equal strings; a branching: (depth, children)

    def leaf(node):
        while isinstance(node, tuple):
            node = next(iter(node[1].values()))
        return node

    for r in rows[1:]:
        s = strings[r]
        node = root
        while isinstance(node, tuple):
            nxt = node[1].get(s[node[0] : node[0] + 1])
            node = leaf(node) if nxt is None else nxt
        other = strings[node[0]]
        at = common(s, other)
        if at == len(s) == len(other):
            node.append(r)
            continue
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < at:
            parent = (node, s[node[0] : node[0] + 1])
            node = node[1][parent[1]]
        if isinstance(node, tuple) and node[0] == at:
            node[1][s[at : at + 1]] = [r]
            continue
        branch = (at, {strings[leaf(node)[0]][at : at + 1]: node, s[at : at + 1]: [r]})
        if parent is None:
            root = branch
        else:
            parent[0][1][parent[1]] = branch
    out: list[int] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The rows of ``strings`` in their order: multikey quicksort by eight bytes a step, then blind tries."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2:
            out.extend(rows)
            continue
        if depth >= shallow:
            out.extend(_blind_trie(strings, rows, depth))
            continue
        keys = [strings[r][depth : depth + 8] for r in rows]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [r for r, k in zip(rows, keys, strict=True) if k < pivot]
        same = [r for r, k in zip(rows, keys, strict=True) if k == pivot]
        more = [r for r, k in zip(rows, keys, strict=True) if k > pivot]
        stack.append((more, depth))
        if len(pivot) < 8:  # these strings end here
            stack.extend(([r], depth) for r in reversed(same))
        else:
            stack.append((same, depth + 8))
        stack.append((less, depth))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed spans as disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Sorted:
    """The contexts around the anchors of one gram, sorted to both sides.

    ``lefts`` are the bytes before each anchor, reversed.
    """

    def __init__(self, lefts: list[bytes], rights: list[bytes]):
        self.by_right, self.by_left = deep_shallow(rights), deep_shallow(lefts)
        self.right = np.array([common(rights[a], rights[b]) for a, b in pairwise(self.by_right)], np.int64)
        self.left = np.array([common(lefts[a], lefts[b]) for a, b in pairwise(self.by_left)], np.int64)
        self.most = max(map(len, lefts))

    def repeated(self, length: int) -> list[list[tuple[int, int]]]:
        """Per anchor, which windows of ``length`` bytes occur at another one: closed ranges of the bytes before the anchor.

        The window that begins i bytes before the anchor is the same at two anchors if they agree in i bytes
        before and length - i bytes from there on.
        """
        by_right, by_left, right, left = self.by_right, self.by_left, self.right, self.left
        c = len(by_right)
        if c == 2:
            a, b = max(length - int(right[0]), 0), int(left[0])
            return [[(a, b)] if a <= b else []] * 2
        if c <= PAIRS:
            r, m = np.zeros((c, c), np.int64), np.zeros((c, c), np.int64)
            for i in range(c - 1):
                r[by_right[i], by_right[i + 1 :]] = np.minimum.accumulate(right[i:])
                m[by_left[i], by_left[i + 1 :]] = np.minimum.accumulate(left[i:])
            low, high = np.maximum(length - np.maximum(r, r.T), 0), np.maximum(m, m.T)
            fit = low <= high
            np.fill_diagonal(fit, False)
            return [_merged(list(set(zip(low[i][fit[i]].tolist(), high[i][fit[i]].tolist(), strict=True)))) for i in range(c)]
        most = min(self.most, length - GRAM)
        again = np.zeros((c, most + 1), bool)
        for i in range(most + 1):
            name = np.zeros(c, np.int64)
            name[by_right] = np.concatenate(([0], np.cumsum(right < length - i))) * c
            name[by_left] += np.concatenate(([0], np.cumsum(left < i)))
            _, own, n = np.unique(name, return_inverse=True, return_counts=True)
            again[:, i] = n[own] > 1
        out = []
        for row in again:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
            out.append([(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)])
        return out


def group_spans(rows: list[tuple[int, int, int, bytes, bytes]]) -> Iterator[tuple[int, int, int, int, bool]]:
    """(key 1, key 2, start, end, whether of ``LENGTH``) of the repeated bytes around the anchors of one gram.

    A row is (key 1, key 2, position, reversed bytes before, bytes from there). Anchors with equal
    contexts are one to the sort, and all their windows repeat.
    """
    classes: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}
    for k1, k2, at, left, right in rows:
        classes.setdefault((left, right), []).append((k1, k2, at))
    order = Sorted([x for x, _ in classes], [x for _, x in classes]) if len(classes) > 1 else None
    for length in (PASSAGE, LENGTH):
        found = order.repeated(length) if order else [[]]
        for ((left, right), places), spans in zip(classes.items(), found, strict=True):
            if len(places) > 1 and length - len(right) <= len(left):
                spans = [(max(0, length - len(right)), len(left))]
            for a, b in spans:
                for k1, k2, at in places:
                    yield k1, k2, at - b, at - a + length, length == LENGTH


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Each different text of a batch once."""
    seen = set()
    for k1, k2, raw in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("raw"), strict=True):
        if (k1, k2) not in seen:
            seen.add((k1, k2))
            yield k1, k2, raw.as_py()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [anchors(np.frombuffer(raw, np.uint8))[1] for _, _, raw in _texts(b)]
        grams, n = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


_CONTEXT = "gram long, k1 long, k2 long, at int, stop int, deep boolean, before binary, after binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
_NAMES = ["gram", "k1", "k2", "at", "stop", "deep", "before", "after"]
_SPAN = "k1 long, k2 long, a int, z int, deep boolean"


def _spot(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams * _C1) >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))


def _contexts(sent, hot):
    """Contexts of the anchors that the filter lets pass; runs known to repeat come with a null gram.

    An anchor of a hot gram comes as its windows' hashes (gram: hash; at, stop: the window's ends).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, frequent = sent.value, hot.value
        for b in batches:
            out: list[tuple] = []
            for k1, k2, raw in _texts(b):
                at, grams, deep, known = anchors(np.frombuffer(raw, np.uint8))
                out.extend((None, k1, k2, a, z, d, None, None) for a, z, d in known)
                spots = _spot(grams)
                told: set[tuple[int, int]] = set()  # a window may hold several hot anchors
                passed = (bits[(spots >> np.uint64(3)).astype(np.int64)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1 == 1
                for p, g, d in zip(at[passed].tolist(), grams[passed].view(np.int64).tolist(), deep[passed].tolist(), strict=True):
                    length = LENGTH if d else PASSAGE
                    if g not in frequent:
                        out.append((g, k1, k2, p, None, d, raw[max(0, p - length + GRAM) : p][::-1], raw[p : p + length]))
                        continue
                    for size in (PASSAGE, LENGTH) if d else (PASSAGE,):
                        for s in range(max(0, p - size + GRAM), min(p, len(raw) - size) + 1):
                            if (s, size) not in told:
                                told.add((s, size))
                                out.append((g, k1, k2, s, s + size, size == LENGTH, hashlib.blake2b(raw[s : s + size], digest_size=16).digest(), None))
                if len(out) >= OUT_ROWS:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram, so a group is a run of rows; it is held until the gram changes."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["k1", "k2", "a", "z", "deep"]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    gram, group = None, []
    for b in batches:
        out: list[tuple] = []
        for g, *row in zip(*(b.column(n).to_pylist() for n in ("gram", "k1", "k2", "at", "before", "after")), strict=True):
            if g != gram:
                if len(group) > 1:
                    out.extend(group_spans(group))
                gram, group = g, []
            group.append(tuple(row))
        yield batch(out)
    if len(group) > 1:
        yield batch(list(group_spans(group)))


def _filter_bits(grams: DataFrame) -> np.ndarray:
    """A fixed-size bitmap of gram hashes: tasks gather bytes, equal bytes meet by bit_or."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots = _spot(b.column("gram").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            word, own = np.unique(spots >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, own, np.uint64(1) << (spots & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = grams.select("gram").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words.view(np.uint8)


def _keyed(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).select(
        "doc_id", F.xxhash64("raw").alias("k1"), F.xxhash64(F.lit(1), "raw").alias("k2"), "raw"
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, spans, passages): per different text (by two 64-bit hashes), the byte spans that repeat, unsorted."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    whole = keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.length("raw")).cast("int").alias("z")).filter((F.col("n") > 1) & (F.col("z") >= PASSAGE))
    sizes = F.filter(F.array(F.lit(PASSAGE), F.lit(LENGTH)), lambda x: x <= F.col("z"))
    whole = whole.select("k1", "k2", F.lit(0).alias("a"), "z", F.explode(sizes).alias("size")).select("k1", "k2", "a", "z", (F.col("size") == LENGTH).alias("deep"))
    counts = keyed.select("k1", "k2", "raw").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = materialize(counts, "grams")
    bits = spark.sparkContext.broadcast(_filter_bits(counts))
    hot = spark.sparkContext.broadcast(_hot_grams(counts))
    contexts = keyed.select("k1", "k2", "raw").mapInArrow(_contexts(bits, hot), _CONTEXT)
    parts = [whole]
    if hot.value:
        contexts = materialize(contexts, "contexts", "zstd")  # mostly text
        windows = contexts.filter("stop is not null and gram is not null")
        twice = materialize(windows.groupBy("before").agg(F.count("*").alias("n")).filter("n > 1").select("before"), "windows")
        parts.append(windows.join(twice, "before", "left_semi").select("k1", "k2", F.col("at").alias("a"), F.col("stop").alias("z"), "deep"))
        contexts = contexts.filter("stop is null or gram is null")
    # Known runs have no gram: a hash of their text spreads them.
    place = F.coalesce("gram", "k1")
    dealt = contexts.withColumn("place", place).repartition("place").sortWithinPartitions("gram", "k1", "k2", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def others() -> Iterator[pa.RecordBatch]:
            for b in batches:
                null = b.column("gram").is_null()
                if null.true_count:
                    known.append(b.filter(null).select(["k1", "k2", "at", "stop", "deep"]).rename_columns(["k1", "k2", "a", "z", "deep"]))
                yield b.filter(b.column("gram").is_valid())

        known: list[pa.RecordBatch] = []
        for out in _sorted_groups(others()):
            yield from known
            known.clear()
            yield out
        yield from known

    spans = dealt.mapInArrow(run, _SPAN)
    for p in parts:
        spans = spans.unionByName(p)
    span = F.struct("a", "z")
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("deep"), span)).alias("spans"), F.collect_set(F.when(~F.col("deep"), span)).alias("passages"))


def _hot_grams(counts: DataFrame) -> frozenset[int]:
    """The grams of more than ``GROUP`` anchors; of more than ``HOT_GRAMS`` only the most frequent, the others are sorted as they are."""
    hot = counts.filter(F.col("n") > GROUP)
    n = hot.count()
    if n > HOT_GRAMS:
        least = hot.approxQuantile("n", [1 - HOT_GRAMS / n], 0.0)[0]
        hot = hot.filter(F.col("n") > least)
    return frozenset(r["gram"] for r in hot.select("gram").collect())


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, removed, runs, repeated, kept = [], [], [], [], []
        for raw, spans, passages in zip(b.column("raw"), b.column("spans").to_pylist(), b.column("passages").to_pylist(), strict=True):
            raw = raw.as_py()
            cut = _merged([(s["a"], s["z"] - 1) for s in spans]) if spans else []
            pieces, at = [], 0
            for a, z in cut:
                pieces.append(raw[at:a])
                at = z + 1
            rest = b"".join([*pieces, raw[at:]])
            sizes.append(len(raw))
            removed.append(len(raw) - len(rest))
            runs.append(len(cut))
            repeated.append(sum(z - a + 1 for a, z in _merged([(s["a"], s["z"] - 1) for s in passages])) if passages else 0)
            kept.append(rest)
        long = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(x, long) for x in (sizes, removed, runs, repeated)), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_repeated, kept) of every row; kept holds the bytes that stay.

    n_repeated counts the bytes covered by a string of ``PASSAGE`` bytes that also starts anywhere else. A null
    text is empty; texts below ``LENGTH`` bytes keep everything. Copies remove each other wholly.
    Repeated rows count as copies. An empty table gives an empty result; other columns are not read.
    """
    keyed = _keyed(docs)
    spans = materialize(repeated_spans(docs), "spans")  # so that a join with very many copies can be split
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "raw", "spans", "passages")
    return joined.mapInArrow(_without, "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    """The digest columns of ``remove_repeats``'s rows."""
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
