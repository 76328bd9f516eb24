"""Requests: searches made once, rasters, grids, and ways over several searches."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from terrapath.operators import reach, requests
from terrapath.shared import new_path

from test_reach import ACROSS, CELL, SIDE, brute, frame, terrain

ASKED = "request_id long, gr int, gc int, start_height double, additional_height double, glide_number double, wind_speed double, wind_direction double, safety_margin double"
ROWS = [
    (1, 5, 5, 100.0, None, None, None, None, None), (2, 5, 5, 100.0, None, 8.0, 0.0, 90.0, None), (3, 5, 5, 100.0, None, 99.0, None, None, None),
    (4, 17, 0, None, 50.0, 10.0, 9.0, 200.0, 30.0), (5, 17, 0, None, 50.0, 10.0, 9.0, 20.0, 30.0), (6, 40, 40, None, None, None, None, None, None),
    (7, 8, 2, -20.0, 4.0, None, -5.0, None, -1.0), (8, 17, 0, None, 50.0, 10.0, 9.0, 200.0, 30.0),
]


@pytest.fixture(scope="module")
def world(spark):
    ground = terrain(11, holes=0)
    store = new_path(spark, "test-searches")
    asked, cells = spark.createDataFrame(ROWS, ASKED), frame(spark, ground)
    made = requests.search_once(asked, cells, SIDE, ACROSS, CELL, store)
    return ground, cells, asked, store, made


def expected(ground, row):
    _, gr, gc, start, more, glide, wind, direction, margin = row
    if (gr, gc) not in ground:
        return None
    low = ground[gr, gc]
    height = max(start if start is not None else low + (10.0 if more is None else more), low)
    p = {"glide": 1 / max(1.0, min(15.0, glide or 8.0)), "trim": 38.0, "wind": max(0.0, wind or 0.0), "wind_dir": 1.5 * math.pi - math.radians(direction or 0.0), "margin": max(0.0, margin or 0.0), "start_distance": 0.0}
    return brute(ground, (gr, gc), height, p), height


def test_equal_requests_are_searched_once_and_rasters_are_right(world):
    ground, cells, asked, store, made = world
    assert made == 6  # 1 and 2 are alike (no wind has no direction), so are 4 and 8
    got = {(x["request_id"], x["r"], x["c"]): x for x in requests.rasters(asked, cells, SIDE, ACROSS, store).collect()}
    metas = {x["request_id"]: x for x in requests.answers(asked, store).collect()}
    assert set(metas) == {1, 2, 3, 4, 5, 7, 8}
    count = 0
    for row in ROWS:
        found = expected(ground, row)
        if found is None:
            continue
        nodes, height = found
        r0, c0 = min(r for r, _ in nodes), min(c for _, c in nodes)
        rows, cols = max(r for r, _ in nodes) - r0 + 1, max(c for _, c in nodes) - c0 + 1
        m = metas[row[0]]
        assert (m["rows"], m["cols"], m["start_r"], m["start_c"], m["n"], m["start_height"], m["ground"]) == (rows, cols, row[1] - r0, row[2] - c0, len(nodes), height, ground[row[1], row[2]])
        for a in range(rows):
            for b in range(cols):
                x, node = got[row[0], a, b], nodes.get((a + r0, b + c0))
                assert x["height"] == pytest.approx(node[0] if node else -1000) and x["agl"] == pytest.approx(node[0] - ground[a + r0, b + c0] if node else -1000)
                assert x["near"] == bool(node and node[3])
                count += 1
    assert count == len(got)


def test_a_second_call_searches_only_what_is_new(world, spark, monkeypatch):
    _, cells, asked, store, _ = world
    monkeypatch.setattr(requests, "reach", lambda *_: pytest.fail("searched again"))
    assert requests.search_once(asked, cells, SIDE, ACROSS, CELL, store) == 0
    monkeypatch.undo()
    more = asked.unionByName(spark.createDataFrame([(9, 12, 12, 90.0, None, None, None, None, None)], ASKED))
    before = requests.stored_nodes(spark, store).count()
    assert requests.search_once(more, cells, SIDE, ACROSS, CELL, store) == 1
    assert requests.stored_searches(spark, store).count() == 7 and requests.stored_nodes(spark, store).count() > before


def test_a_batch_that_was_broken_off_leaves_nothing_behind(spark, monkeypatch):
    ground = terrain(12, holes=0)
    store, cells, asked = new_path(spark, "test-broken"), frame(spark, ground), spark.createDataFrame(ROWS[:1], ASKED)
    # The nodes of a batch whose table of searches was never written.
    found = reach.reach(cells, spark.createDataFrame([(0, 9, 9, 400.0)], "search_id long, gr int, gc int, height double"), SIDE, ACROSS, CELL)
    found.write.parquet(f"{store}/nodes/batch={uuid.uuid4().hex}")
    assert requests.search_once(asked, cells, SIDE, ACROSS, CELL, store) == 1
    assert requests.answers(asked, store).first()["n"] == len(expected(ground, ROWS[0])[0])


def test_grids_margins_and_sizes(spark):
    side, across, down = 40, 3, 2
    cells = spark.range(down * across * side * side).selectExpr(f"id div {side * side} AS tile", f"cast(id % {side * side} div {side} AS int) AS r", f"cast(id % {side} AS int) AS c", "cast(id * 7919 % 3001 AS int) AS h").filter("tile <> 5")
    rows = [(1, 10, 10, None, None), (2, 79, 119, 1.0, 10.0), (3, 20, 50, 2500.0, 250.0), (4, 30, 30, 1e9, 700.0), (5, 80, 0, None, None), (6, 0, 0, 1234.0, 100.0)]
    asked = spark.createDataFrame(rows, "request_id long, gr int, gc int, margin_m double, cell_size double")
    metas = requests.grids(asked, side, across, down, 100.0, (40.0, 5.0), (0.001, 0.002))
    heights = requests.grid_heights(metas, cells, side, across)
    known = {(x["tile"] // across * side + x["r"], x["tile"] % across * side + x["c"]): x["h"] for x in cells.collect()}
    got, meta = {(x["request_id"], x["r"], x["c"]): x["h"] for x in heights.collect()}, {x["request_id"]: x for x in requests.grid_metadata(metas, heights).collect()}
    want = {}
    for i, gr, gc, margin, size in rows[:4] + rows[5:]:
        m = int(max(1_000, min(300_000, margin or 15_000)) // 100)
        r0, r1, c0, c1 = max(0, gr - m), min(down * side - 1, gr + m), max(0, gc - m), min(across * side - 1, gc + m)
        size = max(100.0, size or 100.0)
        n, k = math.ceil((r1 - r0 + 1) * 100 / size), math.ceil((c1 - c0 + 1) * 100 / size)
        x = meta[i]
        assert (x["rows"], x["cols"], x["cell_size"], x["min_cell_size"], x["start_r"], x["start_c"]) == (n, k, size, 100.0, n // 2, k // 2)
        assert (round(x["south"], 6), round(x["east"], 6)) == (round(40 + r0 * 0.001, 6), round(5 + (c1 + 1) * 0.002, 6))
        for a in range(n):
            for b in range(k):
                at = r0 + math.floor(a * ((r1 - r0) / max(n - 1, 1)) + 0.5), c0 + math.floor(b * ((c1 - c0) / max(k - 1, 1)) + 0.5)
                if at in known:
                    want[i, a, b] = known[at]
        assert x["start_height"] == want.get((i, n // 2, k // 2))
    assert got == want and set(meta) == {1, 2, 3, 4, 6}


def test_grids_that_are_not_full_are_refused(spark):
    metas = spark.createDataFrame([(1, 2, 2), (2, 1, 3), (3, 1, 1)], "request_id long, rows int, cols int")
    full = [(1, r, c, 5) for r in (0, 1) for c in (0, 1)] + [(2, 0, c, 5) for c in range(3)] + [(3, 0, 0, 5)]
    cells = spark.createDataFrame(full, "request_id long, r int, c int, h int")
    assert requests.sound_grids(metas, cells) is cells
    for extra, gone, fault in (([(1, 2, 0, 5)], None, "outside"), ([(2, 0, 1, 6)], None, "repeated"), ([], (1, 0, 0), "missing"), ([], (3, 0, 0), "missing"), ([(9, 0, 0, 1)], None, "outside"), ([(1, None, 0, 1)], None, "outside")):
        bad = spark.createDataFrame([x for x in full if x[:3] != gone] + extra, "request_id long, r int, c int, h int")
        with pytest.raises(ValueError, match=fault):
            requests.sound_grids(metas, bad)


def test_ways_over_three_searches(spark):
    ground = terrain(13, holes=0)
    cells = frame(spark, ground)
    first = reach.reach(cells, spark.createDataFrame([(1, 5, 5, 100.0)], "search_id long, gr int, gc int, height double"), SIDE, ACROSS, CELL).cache()
    nodes, starts, far = first, None, first.orderBy(F.desc("dist"), "gr", "gc").first()
    for k in (2, 3):
        picks = spark.createDataFrame([(k, k - 1, far["gr"], far["gc"]), (90 + k, k - 1, 99, 99)], "search_id long, from_search long, gr int, gc int")
        begun = requests.continued(nodes.filter(F.col("search_id") == k - 1), picks)
        assert [tuple(x) for x in begun.collect()] == [(k, far["gr"], far["gc"], far["height"], k - 1)]
        begun = begun.withColumn("height", F.col("height") + 80)
        after = reach.reach(cells, begun, SIDE, ACROSS, CELL).cache()
        nodes, starts, far = nodes.unionByName(after), begun if starts is None else starts.unionByName(begun), after.orderBy(F.desc("dist"), "gr", "gc").first()
    known = {(x["search_id"], x["gr"], x["gc"]): x for x in nodes.collect()}
    begins = {x["search_id"]: (x["from_search"], x["gr"], x["gc"]) for x in starts.collect()}
    want, at = [], (3, far["gr"], far["gc"])
    while at:
        want.append(at)
        x = known[at]
        at = (at[0], x["ref_gr"], x["ref_gc"]) if x["ref_gr"] is not None else begins.get(at[0])
    got = requests.way_back(nodes, starts, spark.createDataFrame([want[0]], "search_id long, gr int, gc int")).orderBy("depth").collect()
    assert [(x["depth"], tuple(x["id"])) for x in got] == list(enumerate(want)) and {1, 2, 3} == {x[0] for x in want}
