"""JSON documents in pieces, views of a map, clamped progress, caches of providers: plain versions and edges."""

import json
import random
import re
from datetime import datetime, timedelta
from itertools import groupby

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrapath.functions import text
from terrapath.operators import progress, requests, tiles, views
from terrapath.shared import new_path
from terrapath.sources import documents

from test_reach import ACROSS, CELL, SIDE, frame, terrain

CORNER, DEGREES = (43.0, 5.0), (0.25, 0.5)


def joined(pieces, key):
    rows = sorted(map(tuple, pieces.select(key, "piece", "text").collect()), key=lambda r: (r[0], r[1]))
    return {k: json.loads("".join(r[2] for r in g)) for k, g in groupby(rows, lambda r: r[0])}


def test_pieces_make_documents(spark):
    metas = spark.createDataFrame([(1, "a", None), (2, 'q"', 5), (3, None, None)], "id long, name string, n int")
    items = spark.createDataFrame([(1, 7, 2, "[2]"), (1, 7, 1, "[1]"), (1, 3, 9, "0"), (2, 0, 0, '"x"'), (9, 0, 0, "1")], "id long, piece int, pos int, item string")
    assert joined(documents.in_pieces(metas, items, "id", "xs"), "id") == {1: {"name": "a", "n": None, "xs": [0, [1], [2]]}, 2: {"name": 'q"', "n": 5, "xs": ["x"]}, 3: {"name": None, "n": None, "xs": []}}
    assert joined(documents.in_pieces(metas.select("id"), items, "id", "xs"), "id")[3] == {"xs": []}
    assert documents.in_pieces(metas.limit(0), items, "id", "xs").count() == 0


def test_documents_are_written_in_order(spark, tmp_path):
    metas = spark.createDataFrame([(k, k * 2) for k in range(20)], "id long, n int")
    items = spark.createDataFrame([(k, p, i, str(p * 10 + i)) for k in range(20) for p in range(k % 4) for i in range(3)], "id long, piece int, pos int, item string")
    documents.write_pieces(documents.in_pieces(metas, items, "id", "xs"), "id", str(tmp_path / "out"))
    whole = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    decoder, at, found = json.JSONDecoder(), 0, []
    while whole[at:].strip():
        at += len(whole[at:]) - len(whole[at:].lstrip())
        doc, at = decoder.raw_decode(whole, at)
        found.append(doc)
    assert found == [{"n": k * 2, "xs": [p * 10 + i for p in range(k % 4) for i in range(3)]} for k in range(20)]


def test_cone_documents_hold_all_nodes(spark):
    ground, store = terrain(11, holes=0), new_path(spark, "test-cones")
    cells = frame(spark, ground)
    asked = spark.createDataFrame([(1, 5, 5, 100.0, "x"), (2, 5, 5, 100.0, "y"), (3, 17, 0, None, None), (4, 40, 400, 90.0, None)], "request_id long, gr int, gc int, start_height double, height string")
    requests.search_once(asked, cells, SIDE, ACROSS, CELL, store)
    metas, nodes = requests.cones(asked, cells, SIDE, ACROSS, CELL, CORNER, DEGREES, store)
    docs = joined(documents.cone_pieces(metas, nodes), "request_id")
    assert set(docs) == {1, 2, 3} and docs[1] == docs[2]
    rasters = {k: {(r["r"], r["c"]): r for r in requests.rasters(asked, cells, SIDE, ACROSS, store).filter(f"request_id = {k} and height > {requests.NOWHERE}").collect()} for k in (1, 3)}
    for k, want in rasters.items():
        doc = docs[k]
        assert {tuple(n["index"]): n["height"] for n in doc["nodes"]} == {at: int(r["height"]) for at, r in want.items()} and len(doc["nodes"]) == len(want)
        start = [n for n in doc["nodes"] if n["reference"] is None]
        assert [n["index"] for n in start] == [doc["start_ix"]] and start[0]["distance"] == 0
        assert all(tuple(n["reference"]) in want for n in doc["nodes"] if n["reference"])
        rows, cols = doc["grid_shape"]
        assert round(doc["lat"][1] - doc["lat"][0], 6) == rows * DEGREES[0] and round(doc["lon"][1] - doc["lon"][0], 6) == cols * DEGREES[1]
        low = doc["lat"][0] - CORNER[0]
        assert all(n["height"] - n["agl"] == ground[n["index"][0] + round(low / DEGREES[0]), n["index"][1] + round((doc["lon"][0] - CORNER[1]) / DEGREES[1])] for n in doc["nodes"])


def test_height_maps_keep_their_shape(spark):
    meta = [(1, 2, 3, 200.0, 200.0, 1, 1, 40.0, 5.0, 41.0, 6.0, 7.0), (2, 1, 1, 200.0, 200.0, 0, 0, 40.0, 5.0, 41.0, 6.0, None)]
    metas = spark.createDataFrame(meta, "request_id long, rows int, cols int, cell_size double, min_cell_size double, start_r int, start_c int, south double, west double, north double, east double, start_height double")
    heights = spark.createDataFrame([(1, 0, 2, 9), (1, 0, 0, 8), (5, 0, 0, 1)], "request_id long, r int, c int, h int")
    docs = joined(documents.height_map_pieces(metas, heights), "request_id")
    assert docs[1]["heights"] == [[8, None, 9], [None, None, None]] and docs[2]["heights"] == [[None]] and docs[2]["start_height"] is None
    assert docs[1]["lat"] == [40.0, 41.0] and docs[1]["grid_shape"] == [2, 3]


def test_place_documents(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 50.0, 50.0, 51.0, 51.0)], "box_id long, south double, west double, north double, east double")
    sites = spark.createDataFrame([(k, f'n"{k}', 0.5 + k / 100, 0.5, None if k % 2 else "Start") for k in range(30)], "id long, name string, lon double, lat double, kind string")
    for limit, n in ((0, 1), (7, 7), (None, 30), (10**9, 30)):
        got = {r["box_id"]: json.loads(r["places"]) for r in documents.place_documents(boxes, sites, limit).collect()}
        assert [p["name"] for p in got[1]] == [f'n"{k}' for k in range(n)] and got[2] == []
    assert got[1][3] == {"name": 'n"3', "center": [0.53, 0.5], "additional_info": None}


def plain_actions(rows, sites):
    out = {}
    for _, group in groupby(sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])), lambda r: r[0] or ""):
        loaded, shown = None, 0
        for _, _, box, zoom, s, w, n, e in group:
            if zoom is None or zoom < 10:
                shown = 0
                out[box] = ("hide", None)
            elif loaded and None not in (s, w, n, e) and loaded[1] <= s and loaded[2] <= w and loaded[3] >= n and loaded[4] >= e and 0 < shown < 100:
                out[box] = ("reuse", loaded[0])
            else:
                whole = None not in (s, w, n, e)
                loaded = (box, s, w, n, e) if whole else None
                shown = sum(s <= lat <= n and w <= lon <= e for lon, lat in sites) if whole else 0
                out[box] = ("search", box)
    return out


def test_views_against_a_plain_fold(spark):
    rng = random.Random(3)
    sites = [(rng.random() * 2, rng.random() * 2) for _ in range(400)]
    rows, began = [], datetime(2024, 1, 1)
    for k in range(600):
        s, w, size = rng.random(), rng.random(), rng.choice((0.1, 0.3, 0.9))
        edge = None if k % 50 == 7 else w + size
        rows.append((rng.choice(("a", "b", None)), began + timedelta(seconds=rng.randrange(300)), k, rng.choice((None, 9, 10, 12, 12, 15, 15, 18)), s, w, s + size, edge))
    views_df = spark.createDataFrame(rows, "session string, ts timestamp, box_id long, zoom int, south double, west double, north double, east double").withColumn("n", F.lit("clash"))
    found = spark.createDataFrame([(k, lon, lat) for k, (lon, lat) in enumerate(sites)], "id long, lon double, lat double")
    got = {r["box_id"]: (r["action"], r["from_box"]) for r in views.plan_views(views_df, found).collect()}
    assert got == plain_actions(rows, sites) and {"hide", "reuse", "search"} == {a for a, _ in got.values()}
    assert views.plan_views(views_df.limit(0), found).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 30)), st.one_of(st.none(), st.integers(0, 900)), st.one_of(st.none(), st.sampled_from([0, 100, 500]))), min_size=1, max_size=40))
def test_progress_against_a_plain_fold(spark, rows):
    totals, before, want = {0: 20, 1: None, 2: 7}, {}, []
    for k, (d, records, done, of) in enumerate(rows):
        total = 1 if totals[d] is None else totals[d]
        guess = int(total * (done or 0) / of + 0.5) if of else before.get(d, 0) + 1
        before[d] = max(0, min(total, max(records or 0, guess, before.get(d, 0))))
        want.append((k, before[d]))
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, at, d, totals[d], r, b, t) for k, (d, r, b, t) in enumerate(rows)], "event_id long, ts timestamp, d int, total int, records int, bytes long, bytes_total long")
    assert sorted(map(tuple, progress.clamped_progress(df, "d").select("event_id", "done").collect())) == want


def test_provider_caches(spark):
    schema = "provider string, zoom int, x int, y int, size long, blob string"
    first = spark.createDataFrame([("topo", 3, 1, 2, 5_000, "a"), ("satellite", 3, 1, 2, 10, "broken")], schema)
    second = spark.createDataFrame([("topo", 3, 1, 2, 6_000, "b"), ("street", 3, 1, 2, 1_000, "c"), ("street", 3, 9, 9, 999, "d")], schema)
    wanted = spark.createDataFrame([(p, 3, 1, 2) for p in ("topo", "street", "satellite", "other", "topo", None)], "provider string, zoom int, x int, y int")
    got = {r["provider"]: (r["blob"], r["upstream"]) for r in tiles.proxied(wanted, [first, second]).collect()}
    assert got == {"topo": ("a", None), "street": ("c", None), "satellite": (None, "satellite/3/2/1"), "other": (None, "other/3/1/2")}
    filled = tiles.fill_cache(first, second.unionByName(second.withColumn("size", F.col("size") + 1)))
    assert sorted(map(tuple, filled.collect())) == [("street", 3, 1, 2, 1_001, "c"), ("street", 3, 9, 9, 1_000, "d"), ("topo", 3, 1, 2, 5_000, "a")]
    again = tiles.proxied(wanted, [filled, second]).filter("blob is null").count()
    assert again == 2


def test_download_ids(spark):
    rows = spark.range(2_000).withColumn("at", F.timestamp_millis(F.lit(1_700_000_000_123)))
    ids = [r[0] for r in rows.select(text.download_id("at", "id")).collect()]
    assert all(re.fullmatch(r"1700000000123-[0-9a-z]{6}", i) for i in ids) and len(set(ids)) > 1_990
    assert ids == [r[0] for r in rows.select(text.download_id("at", "id")).collect()]
