"""Repair of conversation structure at least cost, by layers of reachable grammar states.

A conversation's role initials shall read ``(s?(ua)+)?``. Four grammar states stand between turns: the start, after a
system turn, after a user turn, after an assistant turn. Layer c holds, for each place between turns, the bitset of
the states from which the end is reached at cost c and not below; keeping a sound turn costs nothing and stays in the
layer, every other edit leads to a later one. The first layer that has the start's bit at the first place is the least
cost, and a walk over the bits, trying edits in the order of their letters, gives the least of the cheapest audits.

The turns of all conversations are sorted by ranges and cut into chunks, so a conversation may have any length: the
layers of a chunk start from all four states at its end at once (a bitset of pairs), which gives its costs from state
to state; a scan over these small tables, from the last chunk back, gives what remains to be paid at each chunk's end,
and with that every chunk is traced by itself. Only the digest of the repaired turns, which SHA-256 reads in order, takes
a conversation's turns through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Costs of the edits; a truncated turn that stays costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bits of a chunk's number of turns (1,024): what one task holds of a conversation at a time.
CHUNK_BITS = 10
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that fits, by state; for each, the states it may follow.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: A turn's code: its role's state (0 for other initials) plus a flag for a turn that must go, plus one for a truncated one.
GO, CUT, DUPLICATE = 4, 8, 16

Layers = dict[int, dict[int, int]]


def layers(codes: bytes, ends: tuple[int, ...], lanes: int = 1) -> Layers:
    """cost -> place -> bitset: states from which the end is first reached at that cost.

    ``ends`` gives the cost due at each state after the last turn. With ``lanes`` = 4 a state has four bits, one for each
    state at the end, and each is reached on its own.
    """
    full = (1 << lanes) - 1
    shift = [s * lanes for s in range(4)]

    def before(bits: int, state: int) -> int:
        got = bits >> shift[state] & full
        return sum(got << shift[s] for s in BEFORE[state]) if got else 0

    due: Layers = {}
    for s, cost in enumerate(ends):
        at = due.setdefault(cost, {})
        at[len(codes)] = at.get(len(codes), 0) | (1 << shift[s] + s if lanes == 4 else 1 << s)
    seen, found, cost = [0] * (len(codes) + 1), {}, 0

    def put(c: int, place: int, bits: int) -> None:
        if bits:
            at = due.setdefault(c, {})
            at[place] = at.get(place, 0) | bits

    while due:
        now, layer = due.pop(cost, {}), {}
        for place, bits in sorted(now.items(), reverse=True):
            while bits := bits & ~seen[place]:
                seen[place] |= bits
                layer[place] = layer.get(place, 0) | bits
                other, same = before(bits, USER) | before(bits, ASSISTANT), 0
                put(cost + INSERT, place, other)
                if not place:
                    break
                place -= 1
                code = codes[place]
                more = TRUNCATED if code & CUT else 0
                put(cost + DELETE, place, bits)
                if not code & GO:
                    put(cost + REROLE + more, place, other)
                    same = before(bits, code & 3) if code & 3 else 0
                    put(cost + more, place, same if more else 0)
                bits = 0 if more else same  # a sound turn that stays is still of this layer
        if layer:
            found[cost] = layer
        cost += 1
    return found


@lru_cache(maxsize=20_000)
def table(codes: bytes) -> tuple[int, ...]:
    """The least costs of a chunk, from state s to state t at 4 s + t; -1 where there is no way."""
    costs = [-1] * 16
    for cost, layer in layers(codes, (0, 0, 0, 0), 4).items():
        for pair in range(16):
            if layer.get(0, 0) >> pair & 1:
                costs[pair] = cost
    return tuple(costs)


#: What the states at the end of a conversation still cost: after a system turn an exchange, after a user turn an answer.
AT_END = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=20_000)
def trace(codes: bytes, ends: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """For each state before a chunk: the least of the cheapest audits, up to its last turn, and the state there."""
    found = layers(codes, ends)

    def due(place: int, state: int, cost: int) -> bool:
        return bool(found.get(cost, {}).get(place, 0) >> state & 1)

    out = []
    for state in range(4):
        cost, audit = next(c for c in sorted(found) if due(0, state, c)), []
        for place, code in enumerate(codes):
            more = TRUNCATED if code & CUT else 0
            while True:
                if due(place + 1, state, cost - DELETE):
                    audit.append("D")
                    cost -= DELETE
                elif due(place, NEXT[state], cost - INSERT):
                    audit.append("I")
                    cost, state = cost - INSERT, NEXT[state]
                    continue
                elif not code & GO and code & 3 and state in BEFORE[code & 3] and due(place + 1, code & 3, cost - more):
                    audit.append("K")
                    cost, state = cost - more, code & 3
                else:
                    audit.append("R")
                    cost, state = cost - REROLE - more, NEXT[state]
                break
        out.append(("".join(audit), state))
    return tuple(out)


def damage(turns: DataFrame) -> DataFrame:
    """(key, turn, role, text, copy): the rows after deterministic damage by the hash of ``conv_id:turn``; a null column counts as one space.

    key is ``conv_id`` as a string. Of 20 hash values, 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role
    that of the user.
    """
    plain = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    named = F.concat_ws(":", "key", F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hashed = plain.withColumn("act", F.crc32(named.cast("binary")) % 20).filter("act <> 0")
    return hashed.select(
        "key",
        "turn",
        F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("act") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order of all conversations' turns, written in that order; ``same`` names role and text."""
    same = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    spread = F.monotonically_increasing_id()  # equal rows are any other's equal, but need not share a range
    keyed = rows.withColumn("same", same).withColumn("spread", spread)
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("same"), F.col("spread")]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    put = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return materialize(put.select("key", "turn", "role", "text", "same", "at", F.shiftright("at", CHUNK_BITS).alias("chunk"), blank.alias("blank"), (cut & ~blank).alias("cut")), "turns")


def _chunks(rows: DataFrame) -> DataFrame:
    """(key, chunk, codes): each chunk's turns as codes, in order."""
    slim = rows.select("key", "same", "at", "chunk", "blank", "cut", F.substring("role", 1, 1).alias("initial"))
    first = slim.filter("not blank").groupBy("key", "same").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "same", "first")
    again = F.coalesce(F.col("at") > F.col("first"), F.lit(False)) & ~F.col("blank")
    state = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(0)
    code = state + F.when(F.col("blank"), GO).when(again, GO + DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    coded = slim.join(first, ["key", "same"], "left").select("key", "chunk", "at", code.alias("code"))
    listed = coded.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("turns"))  # a chunk is bounded
    return materialize(listed.select("key", "chunk", F.col("turns.code").cast("array<int>").alias("codes")), "chunks")


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = [bytes(c) for c in b.column(2).to_pylist()]
        costs = pa.array([list(table(c)) for c in codes], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary()), costs], names=["key", "chunk", "codes", "costs"])


def _due(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk leaves to pay, from the chunks after it; rows come by key, the last chunk first. Four numbers are held."""
    key, ends = None, AT_END
    for b in batches:
        out = []
        for k, costs in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            ends = ends if k == key else AT_END
            key = k
            out.append(list(ends))
            ends = tuple(min(costs[4 * s + t] + ends[t] for t in range(4) if costs[4 * s + t] >= 0) for s in range(4))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int64()))], names=["key", "chunk", "codes", "ends"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for codes, ends in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            low = min(ends)  # a common sum changes no choice
            found.append(trace(codes, tuple(e - low for e in ends)))
        audits = pa.array([[a for a, _ in f] for f in found], pa.list_(pa.string()))
        states = pa.array([[s for _, s in f] for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), audits, states], names=["key", "chunk", "codes", "audits", "states"])


class _Digest:
    """A conversation's counts, audit and hash, turn by turn."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False
        self.state, self.role = START, None
        self.codes, self.edits, self.at, self.edit, self.now = b"", "", 0, 0, START

    def chunk(self, codes: bytes, audits: list[str], states: list[int]) -> None:
        self.codes, self.edits, self.at, self.edit, self.now = codes, audits[self.state], 0, 0, self.state
        self.audit.append(self.edits)
        self.state = states[self.state]
        for c in codes:
            self.counts["blank"] += c & GO > 0 and not c & DUPLICATE
            self.counts["duplicate"] += c & DUPLICATE > 0
            self.counts["truncated"] += c & CUT > 0
            self.counts["illegal"] += self.role is not None and (self.role, c & 3) not in LEGAL
            self.role = c & 3

    def write(self, role: str, text: str) -> None:
        self.hash.update(("\n" * self.any + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def insert(self) -> None:
        self.now = NEXT[self.now]
        self.write(ROLES[self.now], "")
        self.counts["cost"] += INSERT

    def turn(self, role: str, text: str) -> None:
        code, self.at = self.codes[self.at], self.at + 1
        while self.edits[self.edit] == "I":
            self.insert()
            self.edit += 1
        what, self.edit = self.edits[self.edit], self.edit + 1
        self.counts["cost"] += {"D": DELETE, "K": 0, "R": REROLE}[what] + (TRUNCATED if what != "D" and code & CUT else 0)
        if what != "D":
            self.now = code & 3 if what == "K" else NEXT[self.now]
            self.write(role if what == "K" else ROLES[self.now], text)

    def end(self) -> tuple:
        while self.now in (SYSTEM, USER):
            self.insert()
            self.audit.append("I")
        return (*self.counts.values(), "".join(self.audit), self.hash.hexdigest())


_OUT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation; rows come by key and chunk, a chunk's edits before its turns."""
    key, now, names = None, None, [c.split()[0] for c in _OUT.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    for b in batches:
        out, cols = [], [b.column(b.schema.get_field_index(c)) for c in ("key", "codes", "audits", "states", "role", "text")]
        for i in range(b.num_rows):
            k, codes = cols[0][i].as_py(), cols[1][i].as_py()
            if k != key:
                if now:
                    out.append((key, *now.end()))
                key, now = k, _Digest()
            if codes is not None:
                now.chunk(codes, cols[2][i].as_py(), cols[3][i].as_py())
            else:
                now.turn(cols[4][i].as_py(), cols[5][i].as_py())
        yield packed(out)
    if now:
        yield packed([(key, *now.end())])


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in ``turns`` after ``damage``.

    Turns are taken by number (null first), those of one number by a hash of role and text, so repeated rows lie side by side and the order of
    the input doesn't matter. A turn's first fault counts: blank, then repeated (role and text seen before), then cut off. Blank and repeated turns
    go; a cut-off one may stay at a cost. The rows of a null ``conv_id`` are one conversation. A conversation whose rows are all dropped has
    zeros, an empty audit and the hash of an empty text. ``gaps`` is null where it doesn't fit a long. Texts and conversations may have any
    length; an empty table gives no rows; other columns are not read.
    """
    rows = _ordered(damage(turns))
    costs = _chunks(rows).mapInArrow(_costs, "key string, chunk long, codes binary, costs array<long>")
    back = costs.repartition("key").sortWithinPartitions("key", F.col("chunk").desc())
    due = back.mapInArrow(_due, "key string, chunk long, codes binary, ends array<long>")
    traced = due.repartition("key", "chunk").mapInArrow(_traced, "key string, chunk long, codes binary, audits array<string>, states array<int>")
    edits = traced.select("key", "chunk", F.lit(-1).cast("long").alias("at"), "codes", "audits", "states", F.lit("").alias("role"), F.lit("").alias("text"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("audits", "array<string>"), ("states", "array<int>"))]
    both = edits.unionByName(rows.select("key", "chunk", "at", *none, "role", "text"))
    found = both.repartition("key").sortWithinPartitions("key", "chunk", "at").mapInArrow(_digests, _OUT)
    whole = F.col("turn").cast("decimal(20,0)")
    numbers = rows.filter("turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key")
    gaps = numbers.agg((F.max(whole) - F.min(whole) + 1 - F.count("*")).try_cast("long").alias("gaps"))
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    numbers_of = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    seen = gaps.withColumn("numbered", F.lit(True))
    return (
        every.join(found, "key", "left").join(seen, "key", "left")
        .select(
            "conv_id",
            F.when(F.col("numbered"), F.col("gaps")).otherwise(F.lit(0)).cast("long").alias("gaps"),
            *numbers_of,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )
