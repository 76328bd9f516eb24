"""Conversation repair against a forward search over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from terrapath.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, key string, codes string, at string, chunk string, cost string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if act == 0:
            continue
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out += [(conv, turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    return out


def repaired(turns_of):
    """(blank, duplicate, truncated, illegal, cost, audit, text): per grammar state the least (cost, audit, text), turn by turn."""
    counts, seen = [0, 0, 0, 0], set()
    now = {"": (0, "", ())}

    def put(into, state, found):
        if state not in into or found < into[state]:
            into[state] = found

    def inserted(states):
        for _ in range(3):
            for s, (c, a, t) in list(states.items()):
                put(states, NEXT[s], (c + 3, a + "I", (*t, NAMES[NEXT[s]] + ":")))
        return states

    initials = [r[:1] for r, _ in turns_of]
    counts[3] = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
    for role, text in turns_of:
        core = text.strip(SPACE)
        blank, again = not core, (role, text) in seen
        cut = not blank and not again and core[-1] not in ".!?"
        seen.add((role, text))
        counts[0] += blank
        counts[1] += again and not blank
        counts[2] += cut
        then = {}
        for s, (c, a, t) in inserted(now).items():
            put(then, s, (c + 4, a + "D", t))
            if not blank and not again:
                if role[:1] and role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[s]:
                    put(then, role[:1], (c + 3 * cut, a + "K", (*t, f"{role}:{text}")))
                put(then, NEXT[s], (c + 3 + 3 * cut, a + "R", (*t, f"{NAMES[NEXT[s]]}:{text}")))
        now = then
    cost, audit, lines = min(v for s, v in inserted(now).items() if s in ("", "a"))
    return (*counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    found = []
    for conv in {r[0] for r in rows}:
        mine = [(t, r, x) for c, t, r, x in damaged(rows) if c == conv]
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, hashlib.sha256(f"{len(m[1])}:{m[1]}:{m[2]}".encode()).hexdigest()))
        known = [t for t, _, _ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        found.append((conv, gaps, *repaired([(r, x) for _, r, x in mine])))
    return sorted(found, key=str)


def messy(seed, convs=40, longest=14):
    r = random.Random(seed)
    said = ["Yes.", "No!", "And then", "Why?  ", "", " \n", "Well.\n", "é. 日本", "…", "a ", None, "Yes.", "x" * 20_000 + ".", ":", "a:b."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "us:er", "agent"]
    rows = []
    for c in range(convs):
        n = r.choice([1, 2, 3, 5, longest])
        rows += [(c - 2 if c else None, r.choice([k, k, k, k // 2, 3 * k, None]), r.choice(roles), r.choice(said)) for k in range(n)]
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(*x, *["clash"] * 5) for x in rows], SCHEMA).repartition(3)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


@pytest.mark.parametrize("bits", [turns.CHUNK_BITS, 0, 2])
def test_repair_equals_a_forward_search(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "CHUNK_BITS", bits)  # down to chunks of one turn
    rows = messy(bits)
    assert as_rows(turns.repair(frame(spark, rows))) == brute(rows)


def test_long_conversations_span_chunks(spark):
    r = random.Random(5)
    rows = [(7, k, r.choice(["user", "assistant", "assistant", "system", "user"]), r.choice(["a.", f"b{k}.", f"c{k}"])) for k in range(3_000)] + [(8, None, "user", "same")] * 2_500
    assert as_rows(turns.repair(frame(spark, rows))) == brute(rows)


def test_empty_and_wholly_dropped(spark):
    assert as_rows(turns.repair(frame(spark, []))) == []
    gone = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    assert as_rows(turns.repair(frame(spark, rows))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] == brute(rows)


def test_extreme_turn_numbers_do_not_overflow(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, 2**63 - 1, "user", "a.")]
    got = {r[0]: r[1] for r in as_rows(turns.repair(frame(spark, rows)))}
    assert got in ({1: None, 2: 0}, {1: 0, 2: 0})  # one of the two ends may have been dropped by the damage


def test_layers_hold_each_state_once_at_its_least_cost():
    r = random.Random(3)
    for _ in range(300):
        codes = bytes(r.choice([0, 1, 2, 3]) + r.choice([0, 0, 4, 8, 20]) for _ in range(r.randint(0, 6)))
        table = turns.table(codes)
        for ends in itertools.product((0, 3, 7), repeat=4):
            found, best = turns.layers(codes, ends), {}
            for cost in sorted(found):
                for s in range(4):
                    if found[cost].get(0, 0) >> s & 1:
                        assert s not in best
                        best[s] = cost
            assert best == {s: min(table[4 * s + t] + ends[t] for t in range(4) if table[4 * s + t] >= 0) for s in range(4)}
