"""Golden cases and round trips of the operators that SQL doesn't check."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from terrapath.functions import flight, geo
from terrapath.operators import placejob, raster, textsearch, tiles
from terrapath.plans import inputs
from terrapath.sources import readers, writers
from terrapath.streaming import streams

SF = "/root/testdata/sf0.001"

@pytest.mark.parametrize(
    ("trim", "wind", "angle", "ratio"),
    [(38.0, 0.0, 1.0, 0.1), (40.0, 10.0, 3.141592653589793, 0.1 / 0.75), (40.0, 40.0 / 2**0.5, 3.141592653589793 / 2, 0.1 * 2**0.5)],
)
def test_effective_glide(spark, trim, wind, angle, ratio):
    got = spark.range(1).select(flight.effective_glide(F.lit(0.1), F.lit(trim), F.lit(wind), F.lit(angle)).alias("g")).first()["g"]
    assert got == pytest.approx(ratio, rel=1e-6)


def test_prefix_matches(spark):
    names = spark.createDataFrame([(x,) for x in ("hello", "helium", "hero", "her", "abba", "aber", "alla", "all")], "name string")
    queries = spark.createDataFrame([("her",), ("he",)], "query string")
    one = {r["name"] for r in textsearch.continuations(names, queries).filter("query = 'he'").collect()}
    assert one == {"her", "hero", "hello", "helium"}
    near = {(r["name"], r["distance"]) for r in textsearch.within_edits(names, queries.filter("query = 'her'"), 2).collect()}
    assert {("her", 0), ("hero", 0), ("aber", 2)} <= near
    assert {r["query"] for r in textsearch.exact(names, queries).collect()} == {"her"}


def test_whole_name_distances(spark):
    names = spark.createDataFrame([(x,) for x in ("hello", "helium", "hero", "her", "abba", "aber", "alla", "all")], "name string")
    query = spark.createDataFrame([("her",)], "query string")

    def found(edits, exactly, *only):
        some = names.filter(F.col("name").isin(*only)) if only else names
        return {r["name"] for r in textsearch.whole_within(some, query, edits, exactly).collect()}

    assert found(2, False) == {"her", "hero", "aber"}
    assert found(1, True, "hero") == {"hero"} and found(2, True, "hero") == set() and found(2, True, "aber") == {"aber"}
    assert found(3, False) == {"her", "hero", "aber", "hello", "all"}  # as many edits as letters


@pytest.mark.parametrize(("zoom", "want"), [(8, [6, 8, 10, 13, 15]), (13, [11, 13, 15]), (15, [13, 15, 17])])
def test_zoom_sets(spark, zoom, want):
    assert spark.range(1).select(tiles.zoom_set(F.lit(zoom)).alias("z")).first()["z"] == want


def test_four_tiles_around_the_origin(spark):
    box = spark.createDataFrame([(1, -1.0, -1.0, 1.0, 1.0)], "box_id long, south double, west double, north double, east double")
    got = {(r["x"], r["y"]) for r in tiles.coverage(box, F.array(F.lit(2))).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2)}


@pytest.mark.parametrize(("a", "b", "t", "want"), [(0, 10, 0.5, 5.0), (1, 6, 0.5, 3.5), (3.5, 7.75, 0.25, 4.5625), (3.5, 8.5, 0.2, 4.5)])
def test_lerp(spark, a, b, t, want):
    assert spark.range(1).select(flight.lerp(a, b, t).alias("x")).first()["x"] == pytest.approx(want)


def test_sql_functions(spark):
    flight.register_functions(spark)
    row = spark.sql("SELECT haversine_m(0D, 0D, 0D, 1D) AS m, lerp(0D, 10D, 0.5D) AS l, tile_x(0D, 2) AS x, tile_y(0.5D, 2) AS y, effective_glide(0.1D, 40D, 10D, pi()) AS g, effective_glide(0.1D, 38D, 50D, 1.57D) AS w").first()
    assert row["m"] == pytest.approx(111_194.9, abs=1) and row["l"] == 5.0 and row["x"] == 2 and row["y"] == 1
    assert row["g"] == pytest.approx(0.1 / 0.75) and row["w"] == float("inf")


def test_elevation_tiles(spark, tmp_path):
    (tmp_path / "N47E011.hgt").write_bytes(struct.pack(">9h", 1, 2, 3, 4, -32768, 6, 7, 8, -1000))
    (tmp_path / "S01W002.hgt").write_bytes(struct.pack(">4h", 5, 5, 5, 5))
    cells = readers.elevation_tiles(spark, str(tmp_path))
    got = {(r["tile_lat"], r["tile_lon"], r["r"], r["c"]): r["h"] for r in cells.collect()}
    assert got[47, 11, 1, 1] == -32768 and got[-1, -2, 0, 0] == 5 and len(got) == 13
    filled = raster.fill_voids(cells, ("tile_lat", "tile_lon"))
    assert {(r["r"], r["c"]): r["h"] for r in filled.filter("tile_lat = 47").collect()} == {(i // 3, i % 3): h for i, h in enumerate([1, 2, 3, 4, 4, 6, 7, 8, -1000])}
    points = spark.createDataFrame([(47.5, 11.5), (10.0, 10.0)], "lat double, lon double")
    assert readers.supported(points, cells).count() == 1
    (tmp_path / "N01E001.hgt").write_bytes(b"123456")
    with pytest.raises(Exception, match="isn't square"):
        readers.elevation_tiles(spark, str(tmp_path)).count()


def test_hgt_names(spark):
    rows = spark.createDataFrame([(47, 11), (-1, -2)], "lat int, lon int").select(geo.hgt_name("lat", "lon").alias("n")).collect()
    assert [r["n"] for r in rows] == ["N47E011.hgt", "S01W002.hgt"]


def test_place_dump(spark, tmp_path):
    place = {"name": {"name": "A"}, "categories": ["osm.place.city"], "centroid": [1.0, 2.0], "address": {}, "country_code": "de"}
    lines = [{"type": "NominatimDumpFile"}, {"type": "Place", "content": [place, place]}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)))
    assert [r["name"]["name"] for r in readers.place_dump(spark, str(tmp_path / "a.json")).collect()] == ["A", "A"]
    (tmp_path / "b.json").write_text(json.dumps({"type": "Other"}))
    with pytest.raises(Exception, match="unknown record type"):
        readers.place_dump(spark, str(tmp_path / "b.json")).collect()


def place(name="A", categories=(), **more):
    return {"name": {"name": name}, "categories": [*categories], "address": {}} | more


def test_cleaning_job(spark, tmp_path):
    town, line = ["osm.place.town"], {"type": "LineString", "coordinates": [[0, 0], [2, 4]]}
    places = [
        place("Point", town, geometry={"type": "Point", "coordinates": [1, 2]}, country_code="at"),
        place("Line", town, geometry=line, country_code="us"),
        place("Odd line", town, geometry={"type": "LineString", "coordinates": [[0, 0], [3, 5], [9, 9]]}),
        place("Ring", town, geometry={"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}),
        place("Rings", town, geometry={"type": "MultiPolygon", "coordinates": [[[[1, 1], [3, 3]]], [[[9, 9]]]]}, address={"state:en": "Tyrol"}),
        place("Known", town, geometry=line, centroid=[7.0, 8.0]),
        place("Shop", ["osm.shop.food"], geometry=line),
        place("Once", ["osm.place.city"], geometry=line),
        place("Garden", ["osm.leisure.park"]),
        place("Garden too", ["osm.leisure.park"]),
        {"categories": town},
    ]
    dump = tmp_path / "dump.json"
    dump.write_text("\n".join(json.dumps({"type": "Place", "content": [p]}) for p in places))
    rows = placejob.augmented(readers.place_dump(spark, str(dump)), "Region")
    got = {r["name"]: (r["center"], r["additional_info"]) for r in rows.collect()}
    assert got == {
        "Point": ([1.0, 2.0], "Austria"), "Line": ([1.0, 2.0], "Region"), "Odd line": ([3.0, 5.0], "Region"), "Ring": ([4.0, 4.0], "Region"),
        "Rings": ([2.0, 2.0], "Tyrol"), "Known": ([7.0, 8.0], "Region"),
    }
    placejob.clean_dump(spark, str(dump), "Region", str(tmp_path / "a"), str(tmp_path / "s"))
    assert readers.augmented_places(spark, str(tmp_path / "a")).count() == 6 and spark.read.text(str(tmp_path / "s")).count() == 0
    kept = placejob.search_places(readers.augmented_places(spark, str(tmp_path / "a")), more_than=5)
    assert kept.columns == ["name", "center", "additional_info"] and kept.count() == 6
    dump.write_text(json.dumps({"type": "Place", "content": [place("Bare", town), place("Bare", town)]}))
    with pytest.raises(Exception, match="no geometry"):
        placejob.augmented(readers.place_dump(spark, str(dump)), "Region").collect()


def test_sites_xml(spark, tmp_path):
    one = "<Location><LocationName> {} </LocationName><LocationType>{}</LocationType><Coordinates>{}</Coordinates></Location>"
    body = "".join(one.format(*x) for x in (("Top", 1, "11.5,47.25"), ("Field", 2, "11.0, 47.0"), ("Winch", 3, "1,1")))
    (tmp_path / "s.xml").write_text(f"<FlyingSites><FlyingSite>{body}</FlyingSite></FlyingSites>")
    got = sorted(map(tuple, readers.sites_xml(spark, str(tmp_path / "s.xml")).collect()))
    assert got == [("Field", "Landing", 11.0, 47.0), ("Top", "Start", 11.5, 47.25)]


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0], None)], "name string, center array<float>, additional_info string")
    writers.json_lines(df, str(tmp_path / "x"))
    for f in (tmp_path / "x").glob("part-*.json"):
        f.rename(f.with_suffix(".jsonl"))
    assert readers.locations(spark, str(tmp_path / "x")).collect() == df.collect()


def test_images(spark):
    cells = raster.fill_voids(inputs.dem(spark, SF), ("tile",)).filter("tile = 3")
    png = writers.images(raster.encode_rg(cells, inputs.SIDE), inputs.SIDE, inputs.SIDE).first()["png"]
    assert png.startswith(b"\x89PNG")
    at = png.index(b"IDAT")
    raw = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    assert len(raw) == inputs.SIDE * (inputs.SIDE * 4 + 1)
    h = {(r["r"], r["c"]): r["h"] for r in cells.collect()}
    line = raw[-(inputs.SIDE * 4 + 1) :]  # the image's last row is the grid's first
    assert line[1 + 4 * 5] * 256 + line[2 + 4 * 5] == h[0, 5]


def test_kml_documents(spark, tmp_path):
    from xml.etree import ElementTree

    cells = raster.corners(raster.fill_voids(inputs.dem(spark, SF), ("tile",)).filter("tile = 3 and r < 4"))
    marks = raster.placemarks(cells, (400, 1300))
    writers.kml(marks.coalesce(1), str(tmp_path / "k"))
    (text,) = [f.read_text() for f in (tmp_path / "k").glob("part-*") if f.read_text()]
    root, space = ElementTree.fromstring(text), "{http://www.opengis.net/kml/2.2}"
    colours = [x.text for x in root.iter(f"{space}color")]
    assert len(colours) == cells.count() and sorted(colours) == sorted(r["colour"] for r in marks.collect())


def test_colour_image_has_four_channels(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 0.0, False), (1, 1, 1, 10.0, False), (1, 1, 2, 20.0, True), (1, 2, 1, -5.0, False), (1, 2, 2, 30.0, True)], "tile long, r int, c int, v double, near boolean")
    pixels = raster.colour_image(nodes, F.col("v"), F.col("near"))
    got = {(p["x"], p["y"]): (p["red"], p["green"], p["blue"], p["alpha"]) for p in pixels.collect()}
    assert got == {(0, 1): (255, 0, 0, 255), (1, 1): (108, 114, 0, 255), (0, 0): (255, 255, 255, 0), (1, 0): (0, 90, 153, 255)}
    png = writers.images(pixels, 2, 2).first()["png"]
    at = png.index(b"IDAT")
    raw = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    assert raw == bytes([0, 255, 255, 255, 0, 0, 90, 153, 255, 0, 255, 0, 0, 255, 108, 114, 0, 255])


def test_cone_json_and_index(spark, tmp_path):
    nodes = spark.createDataFrame([(3, 1, 2, None, None, 80.0, 0.0, False), (3, 1, 3, 1, 2, 70.0, 100.0, True)], "search_id long, r int, c int, ref_r int, ref_c int, height double, distance double, in_margin boolean")
    first = json.loads(writers.cone_json(nodes).first()["node"])
    assert set(first) == {"index", "reference", "height", "distance", "in_safety_margin"}
    names = spark.createDataFrame([("b",), ("a",), (None,)], "name string")
    writers.search_index(names, str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix")).count() == 3


def _events(spark, path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select(*(c.split()[0] for c in streams.EVENTS.split(", "))).repartition(2).write.parquet(path)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "events")
    _events(spark, path)
    total = spark.read.parquet(path).count()
    windows = streams.tumbling(streams.event_stream(spark, path, 10))
    q = windows.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == total
    q = streams.progress(streams.event_stream(spark, path, 10)).writeStream.format("memory").queryName("progress").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    best = {r[0]: r[1] for r in spark.table("progress").groupBy("user_id").agg(F.max("done")).collect()}
    assert best == {r[0]: r[1] for r in spark.read.parquet(path).groupBy("user_id").agg(F.max("value")).collect()}


def _stream_of(spark, path, rows):
    """Events (event_id, minutes, user_id, event_type, value) of a file each, read one by one."""
    for k, row in enumerate(rows):
        e, minutes, user, kind, value = row
        df = spark.createDataFrame([(e, user, kind, value, "{}")], "event_id long, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.expr(f"timestamp'2024-01-01 00:00:00' + interval {minutes} minutes")).select(*(c.split()[0] for c in streams.EVENTS.split(", "))).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(streams.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def _run(df, name, mode, path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_sessions_and_repeats(spark, tmp_path):
    rows = [(1, 0, 7, "a", 1.0), (2, 10, 7, "a", 1.0), (2, 10, 7, "a", 1.0), (3, 100, 7, "b", 1.0), (4, 105, 8, "b", 1.0), (5, 900, 9, "z", 1.0), (6, 901, 9, "z", 1.0)]
    events = _stream_of(spark, str(tmp_path / "e"), rows)
    _run(streams.sessions(events), "sessions", "append", tmp_path / "c1")
    got = sorted((r["user_id"], r["start"].hour * 60 + r["start"].minute, r["n"]) for r in spark.table("sessions").collect())
    assert got == [(7, 0, 3), (7, 100, 1), (8, 105, 1)]  # the last ones may go on
    _run(streams.without_repeats(events), "unique_events", "append", tmp_path / "c2")
    assert sorted(r["event_id"] for r in spark.table("unique_events").collect()) == [1, 2, 3, 4, 5, 6]


def test_progress_ends(spark, tmp_path):
    import time

    rows = [(1, 0, 1, "tile", 30.0), (2, 1, 1, "tile", 150.0), (3, 2, 2, "tile", 10.0), (4, 3, 2, "error", 20.0), (5, 4, 3, "tile", 5.0)]
    events = _stream_of(spark, str(tmp_path / "e"), rows)
    q = streams.progress(events, 100.0, "error", 1.0).writeStream.format("memory").queryName("ends").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            seen = {(r["user_id"], r["done"], r["status"]) for r in spark.table("ends").collect()}
            if (3, 5.0, "stalled") in seen:
                break
    finally:
        q.stop()
    assert {(1, 100.0, "complete"), (2, 20.0, "failed"), (3, 5.0, "running"), (3, 5.0, "stalled")} <= seen


def test_stream_of_queries(spark, tmp_path):
    spark.createDataFrame([("gold",), ("xy",)], "query string").coalesce(1).write.parquet(str(tmp_path / "q"))
    names = spark.createDataFrame([("goldfish",), ("cold",)], "name string")
    got = []
    stream = spark.readStream.schema("query string").parquet(str(tmp_path / "q"))
    streams.answer_queries(stream, names, lambda df, _: got.extend((r["query"], r["name"], r["distance"]) for r in df.collect()), str(tmp_path / "c")).awaitTermination(100)
    assert ("gold", "goldfish", 0) in got and not [x for x in got if x[0] == "xy"]
