"""Reach over blocks against a search that settles cells one by one on one grid."""

import heapq
import math
import random

import pytest

from terrapath.operators import reach

SIDE, ACROSS = 6, 3
WIND = {"glide": 1 / 8, "trim": 38.0, "wind": 9.0, "wind_dir": 1.0, "margin": 12.0, "start_distance": 120.0}
CALM = WIND | {"wind": 0.0}
GALE = WIND | {"wind": 45.0}
STARTS = "search_id long, gr int, gc int, height double"
CELL = 50.0


def loss(dr, dc, p):
    """Metres of height lost on a leg."""
    angle = math.atan2(dr, dc) - p["wind_dir"]
    left = p["trim"] ** 2 - (math.sin(angle) * p["wind"]) ** 2
    speed = math.sqrt(left) + math.cos(angle) * p["wind"] if left > 0 else 0.0
    dist = math.sqrt(dr * dr + dc * dc) * CELL
    return dist * (p["glide"] if p["wind"] == 0 else p["glide"] / (speed / p["trim"])) if speed > 0 else math.inf


def brute(ground, start, height, p):
    """Cell -> (height, dist, reference, near): the greatest height first, each settled for good."""
    if ground.get(start) is None or height < ground[start]:
        return {}
    done, heap = {}, [(-height, ROOT, 0.0, False, 0.0, 0.0, start)]
    while heap:
        h, ref, d, near, hp, dp, at = heapq.heappop(heap)
        if at in done:
            continue
        done[at] = (-h, d, None if ref == ROOT else ref, near)
        for dr, dc in reach.STEPS:
            to = at[0] + dr, at[1] + dc
            if ground.get(to) is None or to in done:
                continue
            offer, from_, from_h, from_d = -h - loss(dr, dc, p), at, -h, d
            if ref != ROOT:
                vr, vc = ref[0] - to[0], ref[1] - to[1]
                most = max(abs(vr), abs(vc))
                if most and (math.floor(vr / most + 0.5), math.floor(vc / most + 0.5)) == (-dr, -dc):
                    straight = hp - loss(-vr, -vc, p)
                    if ground[to] <= straight < -h:
                        offer, from_, from_h, from_d = straight, ref, hp, dp
            if ground[to] <= offer < -h:
                dist = from_d + math.sqrt((to[0] - from_[0]) ** 2 + (to[1] - from_[1]) ** 2) * CELL
                close = near or offer - (p["margin"] if dist >= p["start_distance"] else 0) < ground[to]
                heapq.heappush(heap, (-offer, from_, dist, close, from_h, from_d, to))
    return done


ROOT = (-1, -1)


def terrain(seed, holes=0.05):
    r = random.Random(seed)
    return {(a, b): None if r.random() < holes else r.choice([0, 0, 0, 5, 40, 90]) for a in range(3 * SIDE) for b in range(ACROSS * SIDE) if not (a < SIDE and b >= 2 * SIDE)}  # one tile is missing


def frame(spark, ground):
    return spark.createDataFrame([(a // SIDE * ACROSS + b // SIDE, a % SIDE, b % SIDE, h) for (a, b), h in ground.items()], "tile long, r int, c int, h int")


FROM = [(1, 5, 5, 100.0), (2, 17, 0, 140.0), (3, 9, 9, 3.0), (4, 0, 11, 200.0), (5, 8, 2, 95.0), (6, 40, 40, 100.0), (7, 8, 2, -5.0), (8, 12, 17, 160.0)]


@pytest.mark.parametrize(("p", "block"), [(CALM, 7), (WIND, 9), (GALE, 9), (WIND, 128)], ids=["calm", "wind", "gale", "one-block"])
def test_reach_equals_one_grid(spark, p, block):
    ground = terrain(block)
    found = reach.reach(frame(spark, ground), spark.createDataFrame(FROM, STARTS), SIDE, ACROSS, CELL, block, **p).collect()
    got = {(n["search_id"], n["gr"], n["gc"]): (round(n["height"], 7), round(n["dist"], 7), None if n["ref_gr"] is None else (n["ref_gr"], n["ref_gc"]), n["near"]) for n in found}
    assert len(got) == len(found)
    want = {(k, *at): (round(h, 7), round(d, 7), ref, near) for k, a, b, height in FROM for at, (h, d, ref, near) in brute(ground, (a, b), height, p).items()}
    assert got == want
    assert {True, False} == {v[3] for v in got.values()} or p is GALE
    assert len({(k[1] // block, k[2] // block) for k in got if k[0] == 1}) > 3 or block == 128 or p is GALE


def test_open_ground_is_reached_on_straight_lines(spark):
    """Without obstacles every leg begins at the start, at any angle and over any number of blocks."""
    ground = dict.fromkeys(((a, b) for a in range(3 * SIDE) for b in range(ACROSS * SIDE)), 0)
    found = reach.reach(frame(spark, ground), spark.createDataFrame([(1, 2, 3, 100.0)], STARTS), SIDE, ACROSS, CELL, 4).collect()
    assert len(found) == sum(math.hypot(a - 2, b - 3) * CELL / 8 <= 100 for a, b in ground)
    for n in found:
        assert n["height"] == pytest.approx(100 - math.hypot(n["gr"] - 2, n["gc"] - 3) * CELL / 8)
        assert (n["ref_gr"], n["ref_gc"]) == ((2, 3) if (n["gr"], n["gc"]) != (2, 3) else (None, None))


def test_a_wall_is_flown_around(spark):
    ground = {(a, b): 500 if b == 6 and a < 10 else 0 for a in range(12) for b in range(12)}
    cells = spark.createDataFrame([(0, a, b, h) for (a, b), h in ground.items()], "tile long, r int, c int, h int")
    found = {(n["gr"], n["gc"]): n for n in reach.reach(cells, spark.createDataFrame([(1, 5, 2, 300.0)], STARTS), 12, 1, CELL, 5).collect()}
    behind = found[5, 9]
    assert behind["ref_gr"] >= 10 and behind["dist"] > math.hypot(0, 7) * CELL + 100
    way, at = [], (5, 9)
    while at:
        way.append(at)
        n = found[at]
        at = None if n["ref_gr"] is None else (n["ref_gr"], n["ref_gc"])
    assert way[-1] == (5, 2) and len(way) >= 3
    assert sum(math.dist(a, b) for a, b in zip(way, way[1:], strict=False)) * CELL == pytest.approx(behind["dist"])


def test_searches_bring_their_own_parameters(spark):
    ground = terrain(3)
    rows = [(k, a, b, h, 1 / (6 + k), 38.0 - k, 2.0 * (k % 3), k * 0.7, 5.0 * k, 60.0) for k, a, b, h in FROM]
    names = ("glide", "trim", "wind", "wind_dir", "margin", "start_distance")
    found = reach.reach(frame(spark, ground), spark.createDataFrame(rows, STARTS + "".join(f", {n} double" for n in names)), SIDE, ACROSS, CELL, 5).collect()
    want = {(r[0], *at): round(h, 7) for r in rows for at, (h, *_) in brute(ground, (r[1], r[2]), r[3], dict(zip(names, r[4:], strict=True))).items()}
    assert {(n["search_id"], n["gr"], n["gc"]): round(n["height"], 7) for n in found} == want


def test_no_searches_and_no_ground(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1)], "tile long, r int, c int, h int")
    assert reach.reach(cells, spark.createDataFrame([], STARTS), 1, 1, 50.0).collect() == []
    assert reach.reach(cells.filter("h > 1"), spark.createDataFrame([(1, 0, 0, 9.0)], STARTS), 1, 1, 50.0).collect() == []
