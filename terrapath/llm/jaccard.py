"""Exact Jaccard join of 5-word shingle sets in metric space.

Jaccard distance is a metric. Pivots cut the documents into regions, and a document near a border is
replicated to every region in which it may have a partner. As most pairs of documents share nothing and
lie at distance 1 from any pivot, the first pivots are found with an inverted index: of the sets that
share a shingle of their prefixes, one is the pivot of them all, and a set belongs to the regions of the
few pivots it meets so. Two linked sets always share some of these shingles, hence a region; each
set may leave out its most frequent ones, as long as one is sure to be left, so passages that very many
documents share make no regions. A region that is too large for a task is cut again by
pivots and triangle-inequality windows, recursively; one that fits is joined in a task, by pivots of its own.

Sets are told apart by 128-bit hashes and shingles by 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_text, materialize, new_path, row_key, small_batches
from .graph import components

WORDS = 5
#: Two sets link where PERCENT * union <= 100 * intersection.
PERCENT = 80
#: One in so many shingles lengthens the prefix that partners must share several shingles of.
SPARE = 20
#: Sets of about so many that hold a shingle before it counts as frequent; bits of the bitmap of such shingles.
FREQUENT, FREQUENT_OF, ORDER_BITS = 8, 8_000, 1 << 26
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1_000
#: Bytes of shingles that one task joins at once; regions smaller than ``TASK_BYTES`` are joined several at a time.
REGION_BYTES, TASK_BYTES = 16 << 20, 4 << 20
#: Sets of a region up to which all its pairs are compared at once.
FEW = 4
#: A cut stands if the cells hold no more than so many times the region's bytes, and each no more than such a part.
REPLICAS, SHRINK = 3, 0.8
#: Bytes of pivots that a round broadcasts.
PIVOT_BYTES = 32 << 20
PIVOTS = 16
#: Regions that are cut in one round, so that what is broadcast stays bounded.
REGIONS_A_ROUND = 64
#: Document ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Prefix entries that a task sorts at once before it deals them, and of one bucket.
BLOCK_ENTRIES, BUCKET_ENTRIES = 1_000_000, 750_000
#: Times that nodes with too few shared shingles are taken out.
ROUNDS = 2
#: Bytes of text that are hashed at once; a longer text is hashed alone.
HASHED_BYTES = 1 << 20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


_RANDOM = np.random.default_rng(0x5EED)
#: A random number per byte, the same for both cases of a letter; 0 marks white space.
_BYTE = _RANDOM.integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BASE = _RANDOM.integers(1, 1 << 64, 1, np.uint64)[0] | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE, np.uint64))), dtype=np.uint64)


_POWERS = _powers(256)


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts that lie one after the other, and where each text's words begin.

    A word is hashed as a polynomial of random numbers, one per byte, so that a batch takes a few array
    operations and no step per word.
    """
    value = _BYTE[raw]
    solid = value != 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[1:-1][bounds[1:-1] < len(raw)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    words = np.searchsorted(starts, bounds)
    value = value[solid]
    first = np.flatnonzero(begins[solid])
    if not len(first):
        return np.zeros(0, np.uint64), words
    sizes = np.diff(np.append(first, len(value)))
    place = np.arange(len(value)) - np.repeat(first, sizes)
    longest = int(sizes.max())
    with np.errstate(over="ignore"):
        h = np.add.reduceat(value * (_POWERS if longest <= len(_POWERS) else _powers(longest))[place], first)
        return (h ^ (h >> np.uint64(31))) * _C2, words


def _combined(w: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of ``size`` words."""
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        h = np.full(n, size, np.uint64) * _C2
        for i in range(size):
            h = (h ^ (h >> np.uint64(29))) * _C1 + w[i : n + i]
        h = (h ^ (h >> np.uint64(32))) * _C2
        return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; one for a text of fewer words, none without words."""
    texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + HASHED_BYTES, "right")) - 1)
        w, words = _word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
        runs = _combined(w, WORDS) if len(w) >= WORDS else None
        for a, z in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
            n = z - a
            yield np.unique(runs[a : z - WORDS + 1]) if n >= WORDS else _combined(w[a:z], n) if n else np.zeros(0, np.uint64)
        i = j


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string())))


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-PERCENT * n // 100)


def spare(n: int) -> int:
    return max(1, n // SPARE)


def prefix_size(n: int) -> int:
    """Two linked sets share at least min(spare) of so many of their smallest hashes."""
    return n - least_overlap(n) + spare(n)


def shared_needed(n: int) -> int:
    """Prefix shingles that a set of n shares at least with a set it links to, whatever that one's size."""
    return spare(least_overlap(n))


def _name(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _short(name: bytes) -> int:
    """Part of a set's name, for the index: sets that agree in it only meet in more regions."""
    return int.from_bytes(name[:8], "big", signed=True)


def _spot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * _C1) >> np.uint64(64 - (ORDER_BITS.bit_length() - 1))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in the order's bitmap that many different sets of some documents hold, and all shingles counted."""
    seen: set[bytes] = set()
    spots: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate([*spots, np.zeros(0, np.uint32)]), return_counts=True)
        found = values[n >= FREQUENT]
        word, own = np.unique(found >> np.uint32(6), return_inverse=True)
        bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits, own, np.uint64(1) << (found & np.uint32(63)).astype(np.uint64))
        words, masks = np.append(word.astype(np.int64), -1), np.append(bits.view(np.int64), 0)
        total = np.zeros(len(words), np.int64)
        total[-1] = n.sum()
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(masks), pa.array(total)], names=["word", "bits", "total"])

    for b in batches:
        for s in shingle_sets(b.column("text")):
            key = _name(s)
            if key not in seen:
                seen.add(key)
                spots.append(_spot(s).astype(np.uint32))
        if len(seen) >= FREQUENT_OF:
            yield row()
            seen.clear()
            spots.clear()
    yield row()


def _order_bits(plain: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of fixed size, and the corpus's shingles. Shingles whose bit is set come last in the order of the prefixes.

    Any order is right as long as all documents share it; this one keeps passages that many documents
    share out of the prefixes, so that they don't make partners of strangers.
    """
    found = plain.mapInArrow(_frequent, "word long, bits long, total long").groupBy("word").agg(F.bit_or("bits").alias("bits"), F.sum("total").alias("total"))
    rows = found.toPandas()  # at most one row per word of the bitmap
    total = int(rows["total"].sum())
    rows = rows[rows["word"] >= 0]
    words = np.zeros(ORDER_BITS // 64, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words.view(np.uint64), total


def in_order(s: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The hashes of a set in the order of the prefixes."""
    spots = _spot(s)
    late = (bits[(spots >> np.uint64(6)).astype(np.int64)] >> (spots & np.uint64(63))) & np.uint64(1) == 1
    return np.concatenate((s[~late], s[late])) if late.any() else s


_KINDS = [("doc_id", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("short", pa.int64()), ("bucket", pa.int64()), ("entries", pa.binary())]
#: The bucket of a row whose entries share their shingles within the row.
_SHARED = -1


def _pack(h: np.ndarray, node: np.ndarray) -> bytes:
    """Entries of 48 bits of hash, as byte planes that compress when sorted, and 64 of node."""
    planes = np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(len(h), 8)[:, :6]
    return np.ascontiguousarray(planes.T).tobytes() + node.astype("<i8").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 14
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8, 6 * n).reshape(6, n).T
    return wide.view("<u8").ravel(), np.frombuffer(raw, "<i8", n, 6 * n)


def _dealt(prefixes: list[np.ndarray], nodes: list[int], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Entries of a block of different sets by buckets of shingles: of each shingle only the first node is sent.

    Where several sets of the block share a shingle, all of them have a partner there already: they
    come in the row ``_SHARED``. So a bucket gets one entry per block of a shingle, however many sets hold it.
    """
    h = np.concatenate(prefixes) >> np.uint64(16)
    node = np.repeat(np.array(nodes, np.int64), [len(p) for p in prefixes])
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    sizes = np.diff(np.append(np.flatnonzero(first), len(h)))
    shared = np.repeat(sizes > 1, sizes)
    if shared.any():
        yield _SHARED, _pack(h[shared], node[shared])
    h, node = h[first], node[first]
    bounds = np.searchsorted((h >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for k in range(buckets):
        if bounds[k] < bounds[k + 1]:
            yield k, _pack(h[bounds[k] : bounds[k + 1]], node[bounds[k] : bounds[k + 1]])


def _describe(sent, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows of prefix entries by bucket."""
    seen: set[bytes] = set()  # a copy's prefix is the first one's: of each set a task sends one
    bits = sent.value
    prefixes: list[np.ndarray] = []
    nodes: list[int] = []
    held = 0

    def entries() -> pa.RecordBatch:
        rows = list(_dealt(prefixes, nodes, buckets))
        cols = (*([None] * len(rows) for _ in range(5)), [k for k, _ in rows], [e for _, e in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _KINDS, strict=True)], names=[x for x, _ in _KINDS])

    for b in batches:
        n, node = [], []
        for s in shingle_sets(b.column("text")):
            n.append(len(s))
            key = _name(s) if len(s) else None
            node.append(key)
            if key is not None and key not in seen:
                seen.add(key)
                prefixes.append(in_order(s, bits)[: prefix_size(len(s))])
                nodes.append(_short(key))
                held += len(prefixes[-1])
        none = pa.nulls(len(n), pa.int64())
        short = pa.array([None if x is None else _short(x) for x in node], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), short, none, pa.nulls(len(n), pa.binary())], names=[x for x, _ in _KINDS])
        if held >= BLOCK_ENTRIES:
            yield entries()
            prefixes, nodes, held = [], [], 0
    if prefixes:
        yield entries()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, node, bytes) of the texts whose set is the node's, in each of its regions; a task reads each node's set once."""
    sent: set[bytes] = set()
    for b in batches:
        regions: list[int] = []
        names: list[bytes] = []
        raw: list[bytes] = []
        held = 0
        for found, node, cells in zip(shingle_sets(b.column("text")), b.column("node").to_pylist(), b.column("regions").to_pylist(), strict=True):
            if len(found) and node not in sent and _name(found) == node:
                sent.add(node)
                regions += cells
                names += [node] * len(cells)
                raw += [found.tobytes()] * len(cells)
                held += found.nbytes * len(cells)
            if held > HASHED_BYTES:
                yield _region_rows(regions, names, raw)
                regions, names, raw, held = [], [], [], 0
        yield _region_rows(regions, names, raw)


def _region_rows(regions: list[int], names: list[bytes], raw: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(regions, pa.int64()), pa.array(names, pa.binary()), pa.array(raw, pa.binary())], names=["region", "node", "bytes"])


def _matched(table: pa.Table) -> pa.Table:
    """(h, node) of a bucket's entries whose shingle another node has too."""
    parts = [_unpack(x) for x in table.column("entries").to_pylist()]
    h, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
    h, node = h[fresh], node[fresh]
    sizes = np.diff(np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h)))
    hit = np.repeat(sizes > 1, sizes)
    return pa.table({"h": h[hit].astype(np.int64), "node": node[hit]})


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column("entries").to_pylist():
            h, node = _unpack(raw)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(node)], names=["h", "node"])


def _needs() -> Column:
    return F.expr(f"greatest(1, (({PERCENT} * n + 99) div 100) div {SPARE})")  # shared_needed(n)


def _regions(described: DataFrame, copies: DataFrame) -> DataFrame:
    """(short, region): the regions of each set that may have a partner, a region being named by its pivot.

    Per shingle the pivot is the smallest of the sets that share it (partial aggregates), so a shingle of a
    third of all documents costs each task one row. Sets with too few shared shingles go, and with them
    the shingles that nobody else has then. A set shares ``needed`` shingles or more with any partner: even
    without its ``needed`` - 1 most frequent ones both keep the rarest that they share.
    """
    dealt = described.filter("bucket is not null").select("bucket", "entries")
    found = dealt.filter(F.col("bucket") != _SHARED).groupBy("bucket").applyInArrow(lambda t: _matched(t), "h long, node long")
    inside = dealt.filter(F.col("bucket") == _SHARED).select("entries").mapInArrow(_opened, "h long, node long")
    hits = materialize(found.unionByName(inside).distinct(), "hits")
    # Sets that agree in the short name share its entries: the smaller of their bounds holds for both.
    needs = copies.groupBy(F.col("short").alias("node")).agg(F.min("n").alias("n")).select("node", _needs().alias("needed"))
    for i in range(ROUNDS):
        if i:
            alone = hits.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter("hub = far").select("h")
            hits = hits.join(alone, "h", "left_anti")
        shared = hits.groupBy("node").agg(F.count("*").alias("shared"))
        few = shared.join(needs, "node").filter("shared < needed").select("node")
        hits = materialize(hits.join(few, "node", "left_anti"), "hits")
    pivots = hits.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.count("*").alias("often")).filter("hub < far").select("h", "hub", "often")
    # A set has at most as many rows here as its prefix is long.
    frequent = Window.partitionBy("node").orderBy(F.desc("often"), "h")
    ranked = hits.join(pivots, "h").withColumn("place", F.row_number().over(frequent)).join(needs, "node")
    return ranked.filter(F.col("place") >= F.col("needed")).select(F.col("node").alias("short"), F.col("hub").alias("region")).distinct()


def _parse(content: pa.Array) -> list[np.ndarray]:
    """The sets as views of the column's buffer: nothing is copied."""
    at = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].tolist()
    data = np.frombuffer(content.buffers()[2], np.uint8)
    return [data[a:z].view(np.uint64) for a, z in zip(at[:-1], at[1:], strict=True)]


def _near(inter, a, b, percent: int):
    """Whether the Jaccard similarity is at least ``percent`` in a hundred."""
    return 100 * inter >= percent * (a + b - inter)


def join_region(sets: list[np.ndarray]) -> np.ndarray:
    """The component (as an index) of each set of one region.

    Sets become pivots in turn unless an earlier pivot links to them: then they belong to its cell. Two
    sets of different cells can only link if each is within distance 0.4 of the other's pivot, so
    only those windows are compared, and only between cells that nothing has connected yet.
    """
    g = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every = every[order]
    fresh = np.concatenate(([True], every[1:] != every[:-1]))
    del every
    ids = np.empty(len(order), np.int32)  # narrow arrays, and one sort: a region is large
    ids[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(g, dtype=np.int32), sizes)[order]
    del order
    first = np.append(np.flatnonzero(fresh), len(fresh))
    parent = np.arange(g)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)

    def overlaps(p: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets that share a shingle with p, and how many: from the postings of p's shingles."""
        mine = ids[starts[p] : starts[p + 1]]
        lengths = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        counts = np.bincount(owner[at], minlength=g)
        who = np.flatnonzero(counts)
        return who, counts[who]

    cell = np.full(g, -1)
    windows: dict[int, set[int]] = {}
    for p in range(g):
        if cell[p] >= 0:
            continue
        cell[p] = p
        who, inter = overlaps(p)
        linked = who[_near(inter, sizes[who], sizes[p], PERCENT)]
        for x in linked.tolist():
            union(p, x)
        fresh = linked[cell[linked] < 0]
        cell[fresh] = p
        windows[p] = set(who[_near(inter, sizes[who], sizes[p], 2 * PERCENT - 100)].tolist())
    members = [i for i in range(g) if cell[i] != i]
    reach: dict[int, list[int]] = {}
    for p, near in windows.items():
        for x in near:
            if cell[x] != x and cell[x] != p:
                reach.setdefault(x, []).append(p)
    for x in members:
        todo = [p for p in reach.get(x, ()) if find(p) != find(x)]
        if not todo:
            continue
        own = windows[cell[x]]
        who, inter = overlaps(x)
        for y in who[_near(inter, sizes[who], sizes[x], PERCENT)].tolist():
            if y in own or cell[y] == y:
                union(x, y)
    return np.array([find(i) for i in range(g)])


def _joined(table: pa.Table) -> pa.Table:
    """Links of a few regions, as (node, root), that connect what is connected in each of them."""
    table = table.combine_chunks()
    region, names = table.column("region").to_numpy(), table.column("node").to_pylist()
    sets = _parse(table.column("bytes").chunk(0)) if len(names) else []
    order = np.argsort(region, kind="stable")
    out: list[tuple[bytes, bytes]] = []
    for rows in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
        own = {names[i]: i for i in rows[::-1].tolist()}  # a repeated row comes twice
        some, at = list(own), [sets[i] for i in own.values()]
        if len(some) <= FEW:
            for j, a in enumerate(at):
                for i in range(j):
                    least, most = sorted((len(a), len(at[i])))
                    if 100 * least >= PERCENT * most and _near(len(np.intersect1d(a, at[i], assume_unique=True)), least, most, PERCENT):
                        out.append((some[j], some[i]))
        else:
            out.extend((some[i], some[r]) for i, r in enumerate(join_region(at).tolist()) if i != r)
    cols = list(zip(*out, strict=True)) if out else [(), ()]
    return pa.table({"node": pa.array(cols[0], pa.binary()), "root": pa.array(cols[1], pa.binary())})


def _pivots(regions: DataFrame, large: list[int]) -> dict[int, list[tuple[bytes, np.ndarray]]]:
    """Up to ``PIVOTS`` sets of each region, chosen by hash; together no more than ``PIVOT_BYTES``, but one for each region."""
    share = PIVOT_BYTES // (8 * len(large))
    mine = regions.filter(F.col("region").isin(large))
    size = F.length("bytes")
    # Of sets within the region's share the first by hash; where all are larger, the smallest one.
    chosen = mine.groupBy("region", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("k")).agg(
        F.min_by(F.struct("node", size.alias("size")), F.struct(size > share // PIVOTS * 8, F.xxhash64("node"), "node")).alias("p")
    )
    smallest = mine.groupBy("region").agg(F.min_by("node", F.struct(size, "node")).alias("node"))
    fit = chosen.filter(F.col("p.size") <= share // PIVOTS * 8).select("region", "p.node").unionByName(smallest).distinct()
    out: dict[int, list[tuple[bytes, np.ndarray]]] = {}
    for r in mine.join(F.broadcast(fit), ["region", "node"], "left_semi").dropDuplicates(["region", "node"]).select("region", "node", "bytes").collect():
        out.setdefault(r["region"], []).append((bytes(r["node"]), np.frombuffer(bytes(r["bytes"]), np.uint64)))
    return out


_CELLS = "parent long, region long, node binary, bytes binary, link binary, rest boolean"


def _cut(regions: DataFrame, large: list[int]) -> DataFrame:
    """One round of the recursion for the regions ``large``: their sets by cell, with links to pivots.

    A set within 0.4 of a pivot is covered: every set that links to it lies within 0.6 of that
    pivot, so the pivot's cell takes all sets within 0.6. Uncovered sets link to each other only among
    themselves, or in a cell they were replicated to: they go on as the region's remainder.
    """
    sent = regions.sparkSession.sparkContext.broadcast(_pivots(regions, large))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for region, name, raw in zip(b.column("region").to_pylist(), b.column("node").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                covered = False
                for node, p in sent.value.get(region, ()):
                    inter = len(np.intersect1d(s, p, assume_unique=True))
                    if _near(inter, len(s), len(p), 3 * PERCENT - 200):
                        covered |= bool(_near(inter, len(s), len(p), 2 * PERCENT - 100))
                        cell = _short(xxhash.xxh3_128_digest(region.to_bytes(8, "big", signed=True) + node))
                        out.append((region, cell, name, raw, node if _near(inter, len(s), len(p), PERCENT) else None, False))
                if not covered:
                    out.append((region, region, name, raw, None, True))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _CELLS.split(", ")])

    return materialize(regions.filter(F.col("region").isin(large)).mapInArrow(run, _CELLS), "cells")


def _blocks(rows: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Regions that pivots don't cut, as pairs of blocks of which one holds a set that isn't ``near``.

    ``near`` sets link to one pivot: they are connected already and need no comparison with each other, so they
    are replicated once per block of the others. ``sizes``: bytes of both kinds.
    """
    part = REGION_BYTES // 3
    linked, others = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (near, far) in sizes.items():
        linked = F.when(F.col("region") == k, F.lit(-(-near // part))).otherwise(linked)
        others = F.when(F.col("region") == k, F.lit(-(-far // part))).otherwise(others)
    dealt = rows.withColumn("n_near", linked).withColumn("n_far", others)
    mine = F.pmod(F.xxhash64("node", "region"), F.greatest(F.lit(1), F.when(F.col("near"), F.col("n_near")).otherwise(F.col("n_far")))).cast("int")

    def numbers(count: str, near: bool) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.col(count) - 1, F.lit(0))), lambda x: F.struct(x.alias("block"), F.lit(near).alias("near")))
        return F.slice(every, F.lit(1), F.col(count))

    far = numbers("n_far", False)
    pair = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.when(F.col("near"), far).otherwise(F.concat(far, numbers("n_near", True)))))
    # A block of others and one of linked sets are named by their numbers, two of the others in ascending order.
    block = F.col("other.block")
    one = F.when(F.col("near"), block).when(F.col("other.near"), F.col("mine")).otherwise(F.least("mine", block))
    two = F.when(F.col("near"), F.col("mine")).when(F.col("other.near"), block).otherwise(F.greatest("mine", block))
    name = F.xxhash64("region", F.col("near") | F.col("other.near"), one, two)
    return pair.select(name.alias("region"), "node", "bytes")


def _sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(F.sum(F.length("bytes")).alias("b"), F.count("*").alias("k"))


def _links(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, root): links that connect exactly the components of the sets of each region.

    ``sizes`` has (region, b, k), bytes and sets. Only regions that must be cut are written out for it. A cut stands if
    its cells are smaller than the region and together hold few replicas; else the region is dealt into blocks, once.
    """
    spark = regions.sparkSession
    found_at = None
    pending, final = regions, None
    while True:
        # A pair is never cut: it is joined whatever its size.
        many = sizes.filter((F.col("b") > REGION_BYTES) & (F.col("k") > 2)).orderBy(F.desc("b")).limit(REGIONS_A_ROUND).collect()
        large = {r["region"]: r["b"] for r in many}
        if not large:
            break
        if found_at is None:
            pending, found_at = materialize(pending, "regions"), new_path(spark, "links")
        cells = _cut(pending, list(large))
        cells.filter("link is not null").select("node", F.col("link").alias("root")).filter("node <> root").write.mode("append").parquet(found_at)
        linked = F.when(F.col("link").isNotNull(), F.length("bytes")).otherwise(0)
        by_parent: dict[int, list] = {k: [] for k in large}
        for r in cells.groupBy("parent", "region", "rest").agg(F.sum(F.length("bytes")).alias("b"), F.sum(linked).alias("near")).collect():  # at most pivots + 1 a region
            by_parent[r["parent"]].append(r)
        good, stuck, best = [], {}, {}
        for parent, found in by_parent.items():
            if any(r["near"] == large[parent] for r in found):
                continue  # all of its sets link to one pivot
            todo = [r for r in found if r["near"] < r["b"]]  # a cell whose sets all link to the pivot is done
            if sum(r["b"] for r in todo) <= REPLICAS * large[parent] and all(r["b"] <= SHRINK * large[parent] for r in todo):
                good += [r["region"] for r in todo]
            else:
                most = max(found, key=lambda r: r["near"])
                stuck[parent], best[parent] = (most["near"], large[parent] - most["near"]), most["region"]
        if stuck:
            core = cells.filter(F.col("region").isin(list(best.values())) & F.col("link").isNotNull()).select(F.col("parent").alias("region"), "node", F.lit(True).alias("near")).distinct()
            rows = pending.filter(F.col("region").isin(list(stuck))).dropDuplicates(["region", "node"]).join(core, ["region", "node"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
            blocks = _blocks(rows, stuck)
            final = blocks if final is None else final.unionByName(blocks)
        # From tables that are written already: the replicated rows are only shuffled.
        pending = pending.filter(~F.col("region").isin(list(large))).unionByName(cells.filter(F.col("region").isin(good)).select("region", "node", "bytes"))
        sizes = _sizes(pending)
    total = sizes.agg(F.sum("b")).first()[0] or 0
    if final is not None:
        pending, total = pending.unionByName(final), total + (_sizes(final).agg(F.sum("b")).first()[0] or 0)
    tasks = max(1, total // TASK_BYTES)
    dealt = pending.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(tasks)))
    joined = dealt.groupBy("task").applyInArrow(lambda t: _joined(t.select(["region", "node", "bytes"])), "node binary, root binary")
    return joined.unionByName(spark.read.schema("node binary, root binary").parquet(found_at)) if found_at else joined


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, n, node) of every row, k being its key and node its set, and (node, root, component_id) of the sets."""
    small_batches(docs.sparkSession, BATCH_ROWS)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(docs).alias("k"))
    bits, total = _order_bits(id_text(docs))
    sent = plain.sparkSession.sparkContext.broadcast(bits)
    buckets = max(1, -(-total // SPARE * (SPARE * (100 - PERCENT) // 100 + 1) // BUCKET_ENTRIES))
    described = materialize(plain.mapInArrow(lambda batches: _describe(sent, buckets, batches), "doc_id long, k long, n long, node binary, short long, bucket long, entries binary"), "described")
    texts = described.filter("bucket is null").select("doc_id", "k", "n", "node", "short")
    # Any row of a set can be read for it; ids don't tell rows apart where they are null.
    copies = texts.filter("node is not null").groupBy("node", "short").agg(F.min("doc_id").alias("rep"), F.min("k").alias("k"), F.max("n").alias("n"))
    placed = _regions(described, copies).groupBy("short").agg(F.collect_set("region").alias("regions"))  # no more than a prefix has shingles
    ids = materialize(copies.join(placed, "short").select("node", "regions", "rep", "k", "n"), "ids")
    wanted = ids.select("k", "node", "regions")
    few = ids.count() <= BROADCAST_IDS
    sets = plain.join(F.broadcast(wanted) if few else wanted, "k").select("text", "node", "regions").mapInArrow(_sets, "region long, node binary, bytes binary")
    sizes = ids.select(F.explode("regions").alias("region"), "n").groupBy("region").agg(F.sum(F.col("n") * 8).alias("b"), F.count("*").alias("k"))
    roots = components(_links(sets, sizes), "node", "root")
    # The few nodes that link to another one meet their groups' smallest ids; all others keep their own.
    grouped = materialize(roots.join(ids.select("node", "rep"), "node"), "grouped")
    lowest = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = grouped.join(lowest, "root").select("node", "root", "component_id")
    own = F.col("root").isNull()
    named = copies.select("node", "rep").join(linked, "node", "left")
    return texts.drop("short"), named.select("node", F.coalesce("root", "node").alias("root"), F.when(own, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable by links of similarity 0.8 or more; null ids count only
    where a component has no other. A null, empty or wordless text has no shingles, no links and its own
    id. Equal sets link; of repeated and null ids each row stands for its own text. An empty table gives
    an empty result; other columns are not read.
    """
    texts, named = _linked(docs)
    found = texts.join(named.select("node", "component_id"), "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of the smallest id, null where it has no other.

    Of several texts of that id the one with the smallest key stays, and of equal rows one. Rows without
    words have no links, so all of them stay.
    """
    texts, named = _linked(docs)
    first = materialize(texts.join(named, "node", "left").filter("node is null or doc_id <=> component_id").select("k", "root"), "first")
    chosen = first.filter("root is not null").groupBy("root").agg(F.min("k").alias("k")).select("k")
    kept = chosen.unionByName(first.filter("root is null").select("k")).distinct().select(F.col("k").alias("__k"))
    again = materialize(first.filter("root is not null").groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("k").alias("__k")), "again")
    key = row_key(docs)
    out = docs.join(kept, key == F.col("__k"), "left_semi")
    if again.isEmpty():
        return out
    once = out.join(again, row_key(out) == F.col("__k"), "left_semi")
    single = once.withColumn("__k", row_key(once)).dropDuplicates(["__k"]).drop("__k")
    return out.join(again, row_key(out) == F.col("__k"), "left_anti").unionByName(single)
