"""URL rules through a Bloom filter cascade: exact membership of listed keys without a join.

A rule is a host and a path prefix; its key is both, one after the other. The candidate keys of a
url are its host suffixes with those path prefixes whose length some rule has. All candidate keys of
the corpus are the key universe. Level 1 of a cascade is a Bloom filter of the listed keys, level 2
one of the other universe keys that pass level 1, level 3 one of the listed keys that pass level 2,
and so on until nothing passes wrongly: over the universe, the first level that a key does not pass
tells exactly whether it is listed. The filters' size follows the list, not the corpus, as level 1
is made so tight that about as many keys pass wrongly as are listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Bits of one filter: more keys than fit make a cascade longer, never wrong.
MAX_BITS = 1 << 30
MAX_LEVELS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where "://" is missing."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path prefix of a rule like ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def candidate_keys(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The keys that could match, the longest first: host suffixes of up to as many labels as a rule has."""
    labels = max((split_rule(r)[0].count(".") + 1 for r in rules), default=0)
    lengths = sorted({len(split_rule(r)[1]) for r in rules}, reverse=True)
    if not rules:
        return F.array().cast("array<string>")
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = [F.when((n >= k) & (host != ""), F.array_join(F.slice(parts, -k, k), ".")) for k in range(labels, 0, -1)]
    keys = [F.when(F.length(path) >= m, F.concat(s, F.substring(path, 1, m) if m else F.lit(""))) for s in suffixes for m in lengths]
    return F.reverse(F.array_sort(F.transform(F.array_compact(F.array(*keys)), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))).getField("key")


def key_hashes(key: Column) -> list[Column]:
    """128 hash bits of a key: two hashes of different seeds, the second's being the hash of 1 (after the key, it would follow from the first)."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class Cascade:
    """The filters, level by level: (bits as 64-bit words, number of bits, number of hashes)."""

    def __init__(self, levels: list[tuple[np.ndarray, int, int]]):
        self.levels = levels

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which of the keys with these hashes (64-bit unsigned) are listed."""
        out = np.zeros(len(h1), bool)
        alive = np.arange(len(h1))
        for level, (words, bits, hashes) in enumerate(self.levels):
            passed = _passes(h1[alive], h2[alive], level, words, bits, hashes)
            out[alive[~passed]] = level % 2 == 1
            alive = alive[passed]
        out[alive] = len(self.levels) % 2 == 1
        return out

    @property
    def size_bytes(self) -> int:
        return sum(w.nbytes for w, _, _ in self.levels)


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        a = (h1 + np.uint64(level + 1) * _STEP) * _STEP
        a ^= a >> np.uint64(31)
        b = h2 | np.uint64(1)
        for _ in range(hashes):
            yield a % np.uint64(bits)
            a = (a + b) * _STEP
            a ^= a >> np.uint64(29)


def _passes(h1, h2, level: int, words: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    ok = np.ones(len(h1), bool)
    for p in _positions(h1, h2, level, bits, hashes):
        ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _unsigned(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(b.column(n).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for n in ("h1", "h2"))


def _fill(keys: DataFrame, level: int, n: int, rate: float) -> tuple[np.ndarray, int, int]:
    """A Bloom filter of ``keys``; tasks set their bits, equal words meet by bit_or, the driver gets the words."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = min(MAX_BITS, max(64, -(-round(n * hashes / math.log(2)) // 64) * 64))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate([*_positions(*_unsigned(b), level, bits, hashes), np.zeros(0, np.uint64)])
            at, own = np.unique(p >> np.uint64(6), return_inverse=True)
            words = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(words, own, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(words.view(np.int64))], names=["at", "word"])

    rows = keys.mapInArrow(set_bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return words.view(np.uint64), bits, hashes


def _passing(keys: DataFrame, level: int, filled: tuple[np.ndarray, int, int]) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(filled)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_passes(*_unsigned(b), level, *sent.value)))

    return keys.mapInArrow(test, "h1 long, h2 long")


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the keys ``listed`` over those of ``universe`` (each with distinct h1, h2 columns)."""
    pair = ["h1", "h2"]
    inside = materialize(listed.select(*pair).distinct(), "listed")
    outside = materialize(universe.select(*pair).distinct().join(inside, pair, "left_anti"), "unlisted")
    levels: list[tuple[np.ndarray, int, int]] = []
    n_in, n_out = inside.count(), outside.count()
    while n_in and len(levels) < MAX_LEVELS:
        rate = min(0.5, max(1e-4, n_in / max(n_out, 1) / math.sqrt(2))) if not levels else 0.5
        level = len(levels)
        levels.append(_fill(inside, level, n_in, rate))
        wrong = materialize(_passing(outside, level, levels[-1]), "passed")
        inside, outside, n_in, n_out = wrong, inside, wrong.count(), n_in
    if n_in:
        raise ValueError(f"{n_in} keys still pass wrongly after {MAX_LEVELS} levels; raise MAX_BITS")
    return Cascade(levels)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``rules``: (allow or block, key). The longest rule that fits wins; of two of one length (they can
    differ in where the host ends) the greater string. Without a fitting rule: rule null, verdict
    ``default``. A null url, or one without "://", has empty host and path. Repeated rows are judged
    each; an empty table or an empty rule list is fine; other columns are not read.
    """
    spark = pages.sparkSession
    action = {key: kind for kind, key in rules}
    host, path = host_path(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), list(action)))
    if not action:
        return keyed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = spark.createDataFrame([(k, v == "block") for k, v in action.items()], "key string, block boolean").select(*key_hashes(F.col("key")), "block")
    universe = keyed.select(F.explode("keys").alias("key")).select(*key_hashes(F.col("key")))
    known = build(listed, universe)
    blocked = build(listed.filter("block"), listed)
    sent = spark.sparkContext.broadcast((known, blocked))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocked = sent.value
        for b in batches:
            lists = b.column("hashes")
            flat = lists.flatten()
            h1, h2 = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            hit = np.flatnonzero(known.holds(h1, h2))
            first = np.full(b.num_rows, -1, np.int64)
            first[row[hit[::-1]]] = hit[::-1]
            found = first >= 0
            stop = np.zeros(b.num_rows, bool)
            stop[found] = blocked.holds(h1[first[found]], h2[first[found]])
            starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))[:-1]
            place = pa.array(np.where(found, first - starts + 1, 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("page_id", "host", "path", "keys")] + [place, pa.array(stop)], names=["page_id", "host", "path", "keys", "place", "stop"])

    hashes = F.transform("keys", lambda k: F.struct(*key_hashes(k)))
    kind = dict(keyed.dtypes)["page_id"]
    tested = keyed.withColumn("hashes", hashes).mapInArrow(test, f"page_id {kind}, host string, path string, keys array<string>, place int, stop boolean")
    return tested.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("place") > 0, F.try_element_at("keys", F.col("place"))).alias("rule"),
        F.when(F.col("place") == 0, F.lit(default)).when(F.col("stop"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
