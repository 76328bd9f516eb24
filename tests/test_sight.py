"""Lines of sight by sectors against sampling every line whole; windows over borders of tiles and bands."""

import random

import numpy as np
import pyarrow as pa
import pytest

from terrapath.operators import raster

NAMES = ["clear", "margin", "blocked"]


def brute(ground, start, start_h, cell_m, glide, margin, from_m):
    out = {}
    for (r, c), _ in np.ndenumerate(ground):
        dist = np.sqrt((r - start[0]) ** 2.0 + (c - start[1]) ** 2.0)
        share = np.arange(max(int(np.ceil(dist)), 1) + 1) / max(int(np.ceil(dist)), 1)
        rows, cols = (np.floor(float(a) + (x - float(a)) * share + 0.5).astype(int) for x, a in ((r, start[0]), (c, start[1])))
        low, flown = ground[rows, cols], dist * share * cell_m
        height = start_h - flown * glide
        out[r, c] = "blocked" if (height < low).any() else "margin" if ((flown >= from_m) & (height - margin < low)).any() else "clear"
    return out


@pytest.mark.parametrize("seed", range(60))
def test_states_equal_whole_samples(seed):
    rng = np.random.default_rng(seed)
    shape = tuple(rng.integers(1, 24, 2))
    ground = (rng.integers(0, 1000, shape).astype(float), np.where(rng.random(shape) < 0.07, rng.integers(0, 2000, shape), 0.0), np.cumsum(rng.normal(0, 30, shape), 1))[seed % 3]
    if seed % 4 == 0:
        ground[rng.random(shape) < 0.1] = np.nan
    start = int(rng.integers(0, shape[0])), int(rng.integers(0, shape[1]))
    start_h, glide, margin, from_m = (float(rng.choice(x)) for x in ([300, 800, 1500], [0, 0.1, 0.45], [0, 50, 300], [0, 500]))
    r, c = (x.ravel() for x in np.indices(shape))
    n = len(r)
    t = pa.table({"tile": [1] * n, "r": r, "c": c, "h": pa.array(ground.ravel(), from_pandas=True), "r0": [start[0]] * n, "c0": [start[1]] * n, "start_h": [start_h] * n})
    got = raster._looker(100.0, glide, margin, from_m)(t).to_pylist()
    assert {(x["r"], x["c"]): x["state"] for x in got} == brute(ground, start, start_h, 100.0, glide, margin, from_m)


def test_each_tile_has_its_own_start(spark):
    rng = np.random.default_rng(9)
    tiles = {k: rng.integers(0, 900, (9, 7)) for k in (1, 2, 3)}
    cells = spark.createDataFrame([(k, r, c, int(h)) for k, g in tiles.items() for (r, c), h in np.ndenumerate(g)], "tile long, r int, c int, h int")
    starts = {1: (0, 0, 700.0), 2: (8, 3, 1000.0)}
    found = raster.sight(cells, spark.createDataFrame([(k, *v) for k, v in starts.items()], "tile long, r0 int, c0 int, start_h double"), None, 50.0, 0.3, 40.0, 60.0).collect()
    want = {(k, *at): s for k, (r0, c0, h) in starts.items() for at, s in brute(tiles[k].astype(float), (r0, c0), h, 50.0, 0.3, 40.0, 60.0).items()}
    assert {(x["tile"], x["r"], x["c"]): x["state"] for x in found} == want


def test_windows_cross_bands_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(raster, "BAND", 4)
    r, side, across = random.Random(2), 10, 3
    ground = {(a, b): r.randrange(1_000) for a in range(3 * side) for b in range(across * side) if r.random() < 0.9}
    cells = spark.createDataFrame([(a // side * across + b // side, a % side, b % side, h) for (a, b), h in ground.items()], "tile long, r int, c int, h int")
    points = [(1, 0, 0, 5), (2, 14, 15, 9), (3, 29, 29, 3), (4, 10, 19, 0), (5, -3, 4, 6), (6, 50, 4, 2), (7, 12, -9, 2)]
    got = raster.around(spark.createDataFrame(points, "id long, gr int, gc int, reach int"), cells, side, across).collect()
    want = {(i, a - gr + m, b - gc + m, h) for i, gr, gc, m in points for (a, b), h in ground.items() if abs(a - gr) <= m and abs(b - gc) <= m}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
