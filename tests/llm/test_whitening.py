"""Whitening against a full eigendecomposition."""

import math

import numpy as np
import pytest

from terrapath.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, x string, v string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, *["clash"] * 5) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=4):
    """Rows as the contract has them, components up to their sign."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in kept), default=0)
    kept = [(i, tuple(x) + (0,) * (dims - len(x))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in kept:
        d = [n * a - s for a, s in zip(x, sums, strict=True)]
        for j in range(len(values)):
            w = float(np.array(d) / n @ vectors[:, j] / math.sqrt(values[j])) if values[j] > 1e-9 else None
            out.append((i, j + 1, n, sum(a * a for a in d), w, values[j] / np.trace(c.T @ c / n)))
    return out


def check(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))
    want = sorted(brute(rows), key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for j in {r[1] for r in got}:
        a = [(r[4], w[4]) for r, w in zip(got, want, strict=True) if r[1] == j and r[4] is not None]
        if a:
            mine, theirs = np.array(a).T
            sign = np.sign(mine @ theirs)
            assert np.allclose(mine, sign * theirs, rtol=1e-9, atol=1e-9)
    for r, w in zip(got, want, strict=True):
        assert r[5] == pytest.approx(w[5] if w[4] is not None else 0, rel=1e-9)
        assert r[6] < 1e-10
        assert (r[4] is None) == (w[4] is None)
    return got


def vectors(seed, n, dims):
    r = np.random.default_rng(seed)
    return r.standard_normal((n, dims)) * np.linspace(2, 0.5, dims) @ np.linalg.qr(r.standard_normal((dims, dims)))[0]


@pytest.mark.parametrize("block", [8, 32])
def test_blocks_narrower_than_the_data_converge(spark, block):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(block, 300, 24))]
    df = whitening.whiten(frame(spark, rows), block=block)
    assert len(check(df, rows)) == 1200


def test_messy_rows(spark):
    good = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(1, 60, 6))]
    odd = [(100, None), (101, [0.1, None, 0.3]), (102, [math.nan] * 6), (103, [math.inf, 1.0]), (104, [-math.inf]), (105, []), (106, [0.5]), (107, [-0.0] * 6), (None, [0.25] * 6), (None, [0.25] * 6), (108, [900.0] * 6)]
    rows = good + odd + good[:20]
    got = check(whitening.whiten(frame(spark, rows)), rows)
    assert len(got) == 4 * (60 + 20 + 6)


def test_copies_do_not_weigh(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(2, 40, 5))]
    rows += [(i + 1_000, rows[3][1]) for i in range(500)]
    assert check(whitening.whiten(frame(spark, rows)), rows)[0][2] == 40


def test_few_rows_and_few_dimensions(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        df = whitening.whiten(frame(spark, rows))
        assert df.columns[:2] == ["vec_id", "component"] and df.collect() == []
    check(whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (2, [0.0, 7.0])])), [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (2, [0.0, 7.0])])
    alone = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(alone)] == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]


def test_very_large_entries_are_exact(spark):
    rows = [(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [3e15, 5.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {1: None, 2: None, 3: None}  # beyond a long


def test_a_flat_spectrum_is_certified():
    """Equal eigenvalues have no one basis; any orthonormal one is right."""
    v = np.diag([3.0] * 6 + [1.0] * 14)
    values, q, _ = whitening.components(lambda x: v @ x, 20, 4, block=6)
    assert np.allclose(values, 3) and np.allclose(q.T @ q, np.eye(4)) and np.allclose(v @ q, 3 * q)
