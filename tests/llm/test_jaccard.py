import random

import numpy as np
import pytest

from terrapath.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return text.encode().lower().split() if text else []


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(sets):
        lowest[find(k)] = min(i, lowest.get(find(k), i))
    return sorted((i, len(s), lowest[find(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(40)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 3, 6, 12, 60, 150]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            t[r.randrange(len(t))] = r.choice(vocab)
        if r.random() < 0.3:
            t += passage
        rows.append((i, r.choice([" ", "\n", "\t "]).join(t).title()))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "x" * 100_000)]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumnRenamed("n_chars", "node").repartition(3)
    return sorted(map(tuple, jaccard.link(df).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 2:  # small blocks, many buckets
        monkeypatch.setattr(jaccard, "BUCKET_ENTRIES", 50)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize(("size", "pivots", "pivot_bytes"), [(24_000, 16, jaccard.PIVOT_BYTES), (3_000, 2, 16)])
def test_regions_are_cut(spark, monkeypatch, size, pivots, pivot_bytes):
    monkeypatch.setattr(jaccard, "REGION_BYTES", size)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "PIVOT_BYTES", pivot_bytes)
    rows = corpus(3, 40)
    # A chain of neighbours that pivots hardly cut: blocks end it. Its ends don't link.
    words = [f"c{k}" for k in range(140)]
    rows += [(1000 + k, " ".join(words[2 * k : 2 * k + 60])) for k in range(30)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "q r s t u v"), (2, "A B C D E F G"), (3, "q r s t u v")]
    assert run(spark, rows) == [(1, 2, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 2, 1)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keep_one_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", None, None, 2), (3, None, "en", "s", 3)], SCHEMA)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_packing_round_trip():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 1000).astype(np.uint64))
    node = np.arange(-500, 500)
    a, b = jaccard._unpack(jaccard._pack(h, node))
    assert (a == h).all() and (b == node).all()
