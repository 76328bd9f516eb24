"""Indexes, height images, SQL table functions and sampled means."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapath.functions import tables
from terrapath.operators import requests, textsearch, tiles
from terrapath.sources import index, pictures, writers

from test_reach import ACROSS, CELL, SIDE, frame, terrain
from test_requests import ASKED


def test_a_box_reads_few_files_and_all_its_sites(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, r.uniform(5, 15), r.uniform(43, 49), f"s{k}") for k in range(3_000)] + [(9_000, 10.0, 46.0, "on the edge"), (9_001, -180.0, -90.0, "corner"), (9_002, 180.0, 90.0, "corner"), (9_003, None, 46.0, "nowhere")]
    index.write_sites(spark.createDataFrame(rows, "id long, lon double, lat double, name string"), str(tmp_path), 16)
    every = len(index.files(spark, str(tmp_path), {}))
    assert every >= 12
    for box in ((45.0, 9.0, 46.0, 10.0), (46.0, 10.0, 46.0, 10.0), (43.0, 5.0, 49.0, 15.0), (-90.0, -180.0, -90.0, -180.0), (10.0, 10.0, 20.0, 20.0)):
        got = index.sites_in_box(spark, str(tmp_path), box)
        assert sorted(x["id"] for x in got.collect()) == sorted(k for k, lon, lat, _ in rows if lon is not None and box[0] <= lat <= box[2] and box[1] <= lon <= box[3])
        read = len(index.files(spark, str(tmp_path), {"lon": (box[1], box[3]), "lat": (box[0], box[2])}))
        assert read <= (every if box == (43.0, 5.0, 49.0, 15.0) else every // 3)


def test_a_prefix_reads_few_files_and_all_its_names(spark, tmp_path):
    r = random.Random(2)
    names = ["".join(r.choice("abcdé日\U0010ffff") for _ in range(r.randint(1, 6))) for _ in range(2_000)] + ["", "ab", "ab", "ab￿", "ab\U0010ffff", "ac", "a퟿", "a"]
    index.write_names(spark.createDataFrame([(n,) for n in names], "name string"), str(tmp_path), 12)
    every = len(index.files(spark, str(tmp_path), {}))
    for prefix in ("ab", "a", "日é", "\U0010ffff", "zz", "ab\U0010ffff", "a퟿", ""):
        assert sorted(x["name"] for x in index.names_with_prefix(spark, str(tmp_path), prefix).collect()) == sorted(n for n in names if n.startswith(prefix))
    assert len(index.files(spark, str(tmp_path), {"name": ("ab", "ac")})) <= every // 3


def test_an_empty_index(spark, tmp_path):
    index.write_sites(spark.createDataFrame([], "id long, lon double, lat double"), str(tmp_path))
    assert index.sites_in_box(spark, str(tmp_path), (0.0, 0.0, 9.0, 9.0)).collect() == []


def png(image, kinds, colour=6):
    """A file of which line k has the filter kinds[k % n], made by the format's own definition."""
    rows, cols, n = image.shape
    lines, above = [], np.zeros((cols, n), int)
    for r in range(rows):
        kind, line = kinds[r % len(kinds)], image[r].astype(int)
        left, corner = np.vstack([np.zeros((1, n), int), line[:-1]]), np.vstack([np.zeros((1, n), int), above[:-1]])
        guess = left + above - corner
        a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
        near = (0 * line, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner)))[kind]
        lines.append(bytes([kind]) + ((line - near) & 255).astype(np.uint8).tobytes())
        above = line
    packed = zlib.compress(b"".join(lines))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"a\0b")
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
@pytest.mark.parametrize(("colour", "channels"), [(6, 4), (2, 3), (0, 1), (4, 2)])
def test_every_line_filter(kinds, colour, channels):
    image = np.random.default_rng(channels).integers(0, 256, (11, 7, channels), dtype=np.uint8)
    assert (pictures.pixels(png(image, kinds, colour)) == image).all()


def test_broken_files_are_errors():
    good = png(np.zeros((2, 2, 3), np.uint8), [0], 2)
    for bad in (b"", good[1:], good[:-20], good.replace(b"tEXt", b"tEXT"), png(np.zeros((2, 2, 3), np.uint8), [0], 3)):
        with pytest.raises(ValueError, match="PNG"):
            pictures.pixels(bad)


def test_height_images_come_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    heights = {k: rng.integers(0, 65_536, (6, 9)) for k in (4, 5)}
    cells = [(k, r, c, int(h)) for k, g in heights.items() for (r, c), h in np.ndenumerate(g)]
    pixels = spark.createDataFrame([(k, c, 5 - r, h >> 8, h & 255) for k, r, c, h in cells], "tile long, x int, y int, red int, green int")
    for x in writers.images(pixels, 6, 9).collect():
        (tmp_path / f"{x['tile']}.png").write_bytes(x["png"])
    assert sorted(tuple(x) for x in pictures.height_images(spark, str(tmp_path)).collect()) == sorted(cells)


def test_fuzzy_search_equals_the_dataframe_form(spark):
    r = random.Random(4)
    names = spark.createDataFrame([("".join(r.choice("abcd ") for _ in range(r.randint(0, 9))),) for _ in range(300)] + [(None,), ("o'neil",), ("abca",), ("abcb",)], "name string")
    tables.register_fuzzy_search(spark, names)
    for q in ("abca", "a", "", "dddddddddddd", "o''neil", "zzzzzzzzzzzz", "日本"):
        got = spark.sql(f"SELECT name, distance, rank FROM fuzzy_search('{q}')")
        want = textsearch.best_matches(names, spark.createDataFrame([(q.replace("''", "'"),)], "query string")).select("name", "distance", "rank")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    both = spark.sql("SELECT a.name FROM fuzzy_search('abca') a JOIN fuzzy_search('abcb') b ON a.name = b.name WHERE a.rank < 5")
    assert "Python" not in both._jdf.queryExecution().executedPlan().toString() and both.count() > 0


def test_glide_search_reads_the_store(spark, tmp_path):
    ground = terrain(21, holes=0)
    asked = spark.createDataFrame([(1, 5, 5, 100.0, None, 10.0, 9.0, 200.0, -3.0), (2, 8, 2, None, None, None, None, None, None)], ASKED)
    store = str(tmp_path / "store")
    requests.search_once(asked, frame(spark, ground), SIDE, ACROSS, CELL, store)
    tables.register_glide_search(spark, store)
    by_id = {x["request_id"]: x["n"] for x in requests.answers(asked, store).collect()}
    assert spark.sql("SELECT * FROM glide_search(5, 5, 100D, glide_number => 10D, wind_speed => 9D, wind_direction => 200D)").count() == by_id[1]
    assert spark.sql("SELECT * FROM glide_search(8, 2)").count() == by_id[2]
    assert spark.sql("SELECT * FROM glide_search(8, 2, wind_speed => 1D)").count() == 0


def test_sampled_means_of_small_and_large_strata(spark):
    r = random.Random(5)
    rows = [("topo", 13, x, y, r.randrange(500, 9_000)) for x in range(60) for y in range(50)] + [("street", 15, x, 0, 2_000 + x) for x in range(20)] + [("street", 9, 0, 0, 10)]
    got = {(x["layer"], x["zoom"]): x for x in tiles.sampled_means(spark.createDataFrame(rows, "layer string, zoom int, x int, y int, size long")).collect()}
    assert set(got) == {("topo", 13), ("street", 15)}
    assert got["street", 15]["n_drawn"] == 20 and got["street", 15]["mean_bytes"] == 2_009.5
    sound = [x for x in rows if x[0] == "topo" and x[4] >= 1_000]
    share = -(-tiles.SAMPLED * 10_007 // len(sound))
    drawn = [x[4] for x in sound if (x[2] * 7_919 + x[3] * 104_729 + 13 * 31) % 10_007 < share]
    assert 30 < len(drawn) < 130 and got["topo", 13]["n_drawn"] == len(drawn) and got["topo", 13]["mean_bytes"] == pytest.approx(sum(drawn) / len(drawn))
    windows = spark.createDataFrame([(1, 46.0, 10.0, 46.1, 10.1)], "box_id long, south double, west double, north double, east double")
    means = tiles.sampled_means(spark.createDataFrame(rows, "layer string, zoom int, x int, y int, size long"))
    n = {z: tiles.tile_range(windows, F.array(F.lit(z))).selectExpr("(x1 - x0 + 1) * (y1 - y0 + 1) AS n").first()["n"] for z in (11, 13, 15)}
    found = {x["layer"]: (x["n_tiles"], x["n_bytes"]) for x in tiles.sampled_estimate(windows, F.array(*map(F.lit, n)), means).collect()}
    topo = got["topo", 13]["mean_bytes"]
    fixed = {name: b for name, _, b in tiles.LAYERS}
    assert found == {"topo": (sum(n.values()), round(n[11] * fixed["topo"] + (n[13] + n[15]) * topo)), "street": (sum(n.values()), round((n[11] + n[13]) * fixed["street"] + n[15] * 2_009.5)), "satellite": (sum(n.values()), sum(n.values()) * fixed["satellite"])}
