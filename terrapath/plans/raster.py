"""Queries on elevation tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flight as L
from ..functions import geo as G
from ..operators import raster as R
from . import inputs as I

ABOVE = 700
#: Margin below which a height above ground counts as near, and what holds for it.
NEAR, MARGIN_M, FROM_M = 60, 50.0, 500.0
#: Tiles of a row of the mosaic, and rows of tiles that lie over the box of the lookup.
ACROSS, ROWS = 5, 2


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fill_voids(I.dem(spark, sf_dir), ("tile",))


def dem_void_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir)


def dem_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent and height range of the high cells of each tile."""
    return R.stats(_filled(spark, sf_dir), F.col("h") > ABOVE, by=("tile",))


def dem_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resample(_filled(spark, sf_dir), I.SIDE, I.SIDE, 0.4, 0.7)


def dem_crop_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window over each tile's corner; what lies outside is padded."""
    return R.crop(_filled(spark, sf_dir), -3, 20, 10, 20)


def dem_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site of a box with its tile and the height of its cell, all tiles of the mosaic lying over the box."""
    return R.lookup_tiles(I.sites(spark, sf_dir), _filled(spark, sf_dir), I.SIDE, ACROSS, (44.0, 6.0, 48.0, 14.0), (ROWS, ACROSS))


def dem_encode_rg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.encode_rg(_filled(spark, sf_dir), I.SIDE)


def dem_decode_rg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image's heights: what comes back is the clamped height of the cell."""
    return R.decode_rg(R.encode_rg(_filled(spark, sf_dir), I.SIDE), I.SIDE)


def agl_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of heights above 700 m, scaled to each tile's range."""
    cells = _filled(spark, sf_dir).filter(F.col("h") > ABOVE)
    span = cells.groupBy("tile").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    s = (F.col("h") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1))
    return cells.join(span, "tile").select("tile", "r", "c", *(L.colour_channel(s, i).alias(n) for i, n in enumerate(("red", "green", "blue"))))


def agl_raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _filled(spark, sf_dir).select("tile", "r", "c", (F.col("h") - ABOVE).alias("agl"), (F.col("r") % 2 == 0).alias("in_margin")).filter("agl >= 0")
    return R.agl_raw(nodes)


def grid_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of all tiles, with height above ground of the nodes that reach them; -1000 elsewhere."""
    nodes = I.tree(spark, sf_dir).filter(f"r < {I.SIDE} AND c < {I.SIDE}").groupBy("r", "c").agg(F.max("h").alias("node_h"))
    height = F.col("node_h").cast("int")
    joined = _filled(spark, sf_dir).join(nodes, ["r", "c"], "left")
    return joined.select("tile", "r", "c", F.coalesce(height - F.col("h"), F.lit(-1000)).alias("agl"), F.coalesce(height, F.lit(-1000)).alias("height"))


def neighbor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How steep each cell is toward its four neighbours."""
    pairs = R.neighbours(_filled(spark, sf_dir))
    return pairs.groupBy("tile", "r", "c").agg(F.count("*").alias("n"), F.max(F.col("nh") - F.col("h")).alias("up"), F.min(F.col("nh") - F.col("h")).alias("down"))


def line_of_sight_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a straight glide from the middle of each tile reaches."""
    return R.line_of_sight(_filled(spark, sf_dir), (16, 16), 2000.0, 100.0, 0.45)


def line_of_sight_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the straight glide from the middle of each tile to each of its cells is blocked, in the margin or clear."""
    return R.sight(_filled(spark, sf_dir), (16, 16), 2000.0, 100.0, 0.45, MARGIN_M, FROM_M)


def _global_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, gr, gc, start_height): the sites of a box as cells of the mosaic over it; some bring a start height."""
    inside = I.sites(spark, sf_dir).filter(G.bbox_contains(44.0, 6.0, 48.0, 14.0, "lat", "lon"))
    start = F.when(F.col("id") % 3 == 0, (600 + F.col("id") % 7 * 100).cast("double"))
    return inside.select("id", G.coordinate_to_index("lat", ROWS * I.SIDE, 44.0, 48.0).alias("gr"), G.coordinate_to_index("lon", ACROSS * I.SIDE, 6.0, 14.0).alias("gc"), start.alias("start_height"))


def search_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground, start height and reach in cells of 1 km of a search from each site."""
    found = R.search_setup(_global_sites(spark, sf_dir), _filled(spark, sf_dir), I.SIDE, ACROSS, 1000.0, 0.125, 38.0, 6.0, 50.0)
    return found.select("id", "ground", "height", "reach")


def dem_around_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that each site's search can reach, over the borders of tiles: its cells, box and heights."""
    cells = _filled(spark, sf_dir)
    points = R.search_setup(_global_sites(spark, sf_dir), cells, I.SIDE, ACROSS, 1000.0, 0.125, 38.0, 6.0, 50.0)
    # Sites of one cell and reach see the same window, which is made once.
    window = F.struct("gr", "gc", "reach")
    near = R.around(points.select("gr", "gc", "reach").distinct().withColumn("id", window), cells, I.SIDE, ACROSS)
    seen = near.groupBy("id").agg(F.count("*").alias("n"), F.sum("h").alias("sum_h"), *(f(x).alias(f"{x}_{n}") for x in ("r", "c", "h") for n, f in (("min", F.min), ("max", F.max))))
    return points.select("id", "gr", "gc", "reach").join(seen.select("id.gr", "id.gc", "id.reach", *seen.columns[1:]), ["gr", "gc", "reach"]).select("id", *seen.columns[1:])


def dem_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 90 by 60 m as square ones, with the new side and the degrees of a column."""
    square, side = R.squared(_filled(spark, sf_dir), I.SIDE, I.SIDE, 90.0, 60.0)
    new = square.groupBy("tile").agg(F.count("*").alias("n"), F.sum("h").alias("sum_h"), (F.max("c") + 1).alias("columns"))
    return new.select("tile", "n", "sum_h", F.lit(side).alias("side"), F.round(G.angular_resolution(F.lit(6.0), F.lit(7.0), "columns"), 9).alias("degrees"))


def _above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).withColumn("agl", F.col("h") - ABOVE)


def agl_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture of heights above 700 m: darker where less than 60 m, white and clear below."""
    return R.colour_image(_above(spark, sf_dir), F.col("agl"), F.col("agl") < NEAR, 20.0)


def height_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture of the heights of all high cells."""
    return R.colour_image(_above(spark, sf_dir), F.when(F.col("agl") > 0, F.col("h")).otherwise(0), F.col("agl") < NEAR)


def dem_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles laid side by side in rows of five, as blocks of mean height in global cells."""
    cells = _filled(spark, sf_dir)
    return R.mosaic(cells, I.SIDE, 5).groupBy(F.expr("gr div 8").cast("int").alias("br"), F.expr("gc div 8").cast("int").alias("bc")).agg(F.count("*").alias("n"), F.sum("h").alias("sum_h"))


def kml_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heights of each cell's four corners: a neighbour's where there is one, else its own."""
    return R.corners(_filled(spark, sf_dir))


def kml_placemarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon text per high cell of every tile."""
    return R.placemarks(R.corners(_filled(spark, sf_dir)).filter(F.col("h") > ABOVE), (ABOVE, 1300), keep_tile=True)


def point_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites per grid cell of a box: the cell is computed, not searched."""
    inside = I.sites(spark, sf_dir).filter(G.bbox_contains(44.0, 6.0, 48.0, 14.0, "lat", "lon"))
    return inside.groupBy(G.coordinate_to_index("lat", 20, 44.0, 48.0).alias("r"), G.coordinate_to_index("lon", 40, 6.0, 14.0).alias("c")).agg(F.count("*").alias("n"))


QUERIES = (
    dem_void_fill, dem_stats, dem_resample, dem_crop_pad, dem_point_lookup, dem_encode_rg, dem_decode_rg, agl_colors, agl_raw_pixels,
    grid_rasters, neighbor_pairs, line_of_sight_reachable, line_of_sight_class, search_setup, dem_around_point, dem_squared, agl_image, height_image,
    dem_mosaic, kml_corners, kml_placemarks, point_in_cell,
)

_F = f"""(SELECT tile, r, c, last_value(CASE WHEN h >= -1000 THEN h END IGNORE NULLS) OVER (PARTITION BY tile ORDER BY r, c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM {I.DEM})"""
_N = I.SIDE


def _axis(n_new: int) -> str:
    return f"(SELECT range AS t, cast(round(range * {(_N - 1) / (n_new - 1)}::DOUBLE) AS int) AS a FROM range({n_new}))"


# The colours stand here once more, so that the SQL checks those of the operators.
_HALF, _REST = "s >= 0 AND s < 0.5 THEN", "s >= 0.5 AND s < 1 THEN"
_T, _U = "(s / 0.5::DOUBLE)", "((s - 0.5::DOUBLE) / 0.5::DOUBLE)"
_CHANNELS = [
    f"cast(floor(CASE WHEN {_HALF} 255 - 75 * {_T} WHEN {_REST} 180 - 180 * {_U} ELSE 0 END) AS int)",
    f"cast(floor(CASE WHEN {_HALF} 190 * {_T} WHEN {_REST} 190 - 40 * {_U} ELSE 150 END) AS int)",
    f"cast(floor(CASE WHEN {_HALF} 0 * {_T} WHEN {_REST} 255 * {_U} ELSE 255 END) AS int)",
]
_MARGIN = [
    f"cast(floor(CASE WHEN {_HALF} 153 - 45 * {_T} WHEN {_REST} 108 - 108 * {_U} ELSE 0 END) AS int)",
    f"cast(floor(CASE WHEN {_HALF} 114 * {_T} WHEN {_REST} 114 - 24 * {_U} ELSE 90 END) AS int)",
    f"cast(floor(CASE WHEN {_HALF} 0 * {_T} WHEN {_REST} 153 * {_U} ELSE 153 END) AS int)",
]


def _channel(i: int) -> str:
    return _CHANNELS[i]


def _image(value: str, s: str) -> str:
    names = ("red", "green", "blue")
    picks = ", ".join(f"CASE WHEN v <= 0 THEN 255 WHEN agl < {NEAR} THEN {_MARGIN[i]} ELSE {_CHANNELS[i]} END AS {n}" for i, n in enumerate(names))
    return f"""WITH v AS (SELECT tile, r, c, h - {ABOVE} AS agl, ({value})::DOUBLE AS v FROM {_F}),
 box AS (SELECT tile, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, min(v) AS low, max(v) AS high FROM v WHERE v > 0 GROUP BY tile),
 x AS (SELECT *, {s} AS s FROM v JOIN box USING (tile) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1)
 SELECT tile, cast(c - c0 AS int) AS x, cast(r1 - r AS int) AS y, {picks}, CASE WHEN v > 0 THEN 255 ELSE 0 END AS alpha FROM x"""


def _setup() -> str:
    return f"""(SELECT id, gr, gc, ground, height, cast(floor((height / (0.125::DOUBLE / ((6.0::DOUBLE + 38.0::DOUBLE) / 38.0::DOUBLE)) + 1) / 1000.0::DOUBLE) AS int) AS reach FROM
 (SELECT p.id, gr, gc, h AS ground, greatest(coalesce(CASE WHEN p.id % 3 = 0 THEN (600 + p.id % 7 * 100)::DOUBLE END, h + 50.0::DOUBLE), h::DOUBLE) AS height FROM
 (SELECT id, cast(greatest(0, least({ROWS * _N - 1}, floor((lat - 44.0::DOUBLE) / 4.0::DOUBLE * {ROWS * _N}))) AS int) AS gr,
 cast(greatest(0, least({ACROSS * _N - 1}, floor((lon - 6.0::DOUBLE) / 8.0::DOUBLE * {ACROSS * _N}))) AS int) AS gc FROM {I.SITES} WHERE lat BETWEEN 44 AND 48 AND lon BETWEEN 6 AND 14) p
 JOIN {_F} f ON f.tile = gr // {_N} * {ACROSS} + gc // {_N} AND f.r = gr % {_N} AND f.c = gc % {_N}))"""


_LINES = f""", d AS (SELECT *, sqrt((r - 16) * (r - 16) + (c - 16) * (c - 16)) AS dist FROM f), n AS (SELECT *, cast(greatest(ceil(dist), 1) AS int) AS k FROM d),
 s AS (SELECT *, unnest(range(0, k + 1)) AS i FROM n), p AS (SELECT tile, r, c, dist, cast(round(16.0::DOUBLE + (r - 16) * (i / k::DOUBLE)) AS int) AS sr, cast(round(16.0::DOUBLE + (c - 16) * (i / k::DOUBLE)) AS int) AS sc,
 dist * (i / k::DOUBLE) * 100.0::DOUBLE AS flown, 2000.0::DOUBLE - dist * (i / k::DOUBLE) * 100.0::DOUBLE * 0.45::DOUBLE AS flight FROM s)"""
_SPAN = f"(SELECT *, min(h) OVER (PARTITION BY tile) AS low, max(h) OVER (PARTITION BY tile) AS high FROM {_F} WHERE h > {ABOVE})"
_CORNER = f"""(SELECT a.tile, a.r, a.c, a.h, coalesce(u.h, a.h) AS h_up, coalesce(x.h, a.h) AS h_right, coalesce(d.h, a.h) AS h_diag FROM {_F} a
 LEFT JOIN {_F} u ON a.tile = u.tile AND a.r + 1 = u.r AND a.c = u.c LEFT JOIN {_F} x ON a.tile = x.tile AND a.r = x.r AND a.c + 1 = x.c
 LEFT JOIN {_F} d ON a.tile = d.tile AND a.r + 1 = d.r AND a.c + 1 = d.c)"""
_CLAMP = "greatest(0, least(65535, h))"
SQL = {
    "dem_void_fill": f"SELECT tile, r, c, h FROM {_F}",
    "dem_stats": f"SELECT tile, count(*) AS n, min(h) AS h_min, max(h) AS h_max, min(r) AS r_min, max(r) AS r_max, min(c) AS c_min, max(c) AS c_max FROM {_F} WHERE h > {ABOVE} GROUP BY tile",
    "dem_resample": f"SELECT tile, cast(y.t AS int) AS r, cast(x.t AS int) AS c, h FROM {_F} f JOIN {_axis(13)} y ON f.r = y.a JOIN {_axis(23)} x ON f.c = x.a",
    "dem_crop_pad": f"""SELECT t.tile, cast(y.range AS int) AS r, cast(x.range AS int) AS c, coalesce(h, 9999) AS h FROM (SELECT DISTINCT tile FROM {I.DEM}) t, range(10) y, range(20) x
 LEFT JOIN {_F} f ON f.tile = t.tile AND f.r = y.range - 3 AND f.c = x.range + 20""",
    "dem_encode_rg": f"SELECT tile, c AS x, {_N - 1} - r AS y, cast({_CLAMP} // 256 AS int) AS red, cast({_CLAMP} % 256 AS int) AS green FROM {_F}",
    "dem_decode_rg": f"SELECT tile, r, c, cast({_CLAMP} AS int) AS h FROM {_F}",
    "agl_colors": f"SELECT tile, r, c, {_channel(0)} AS red, {_channel(1)} AS green, {_channel(2)} AS blue FROM (SELECT tile, r, c, (h - low) / greatest(high - low, 1)::DOUBLE AS s FROM {_SPAN})",
    "agl_raw_pixels": f"SELECT tile, r, c, cast((h - {ABOVE}) // 256 AS int) AS red, cast((h - {ABOVE}) % 256 AS int) AS green, CASE WHEN r % 2 = 0 THEN 128 ELSE 255 END AS blue FROM {_F} WHERE h >= {ABOVE}",
    "neighbor_pairs": f"""SELECT a.tile, a.r, a.c, count(*) AS n, max(b.h - a.h) AS up, min(b.h - a.h) AS down FROM {_F} a JOIN (SELECT tile, r + dr AS r, c + dc AS c, h
 FROM {_F}, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dr, dc)) b ON a.tile = b.tile AND a.r = b.r AND a.c = b.c GROUP BY 1, 2, 3""",
    "line_of_sight_reachable": f"""WITH f AS (SELECT * FROM {_F}){_LINES}
 SELECT p.tile, p.r, p.c, round(2000.0::DOUBLE - dist * 100.0::DOUBLE * 0.45::DOUBLE, 6) AS height FROM p JOIN f ON p.tile = f.tile AND p.sr = f.r AND p.sc = f.c
 GROUP BY p.tile, p.r, p.c, dist HAVING NOT bool_or(flight < f.h)""",
    "line_of_sight_class": f"""WITH f AS (SELECT * FROM {_F}){_LINES}
 SELECT p.tile, p.r, p.c, round(2000.0::DOUBLE - dist * 100.0::DOUBLE * 0.45::DOUBLE, 6) AS height,
 CASE WHEN bool_or(flight < f.h) THEN 'blocked' WHEN bool_or(flown >= {FROM_M} AND flight - {MARGIN_M} < f.h) THEN 'margin' ELSE 'clear' END AS state
 FROM p JOIN f ON p.tile = f.tile AND p.sr = f.r AND p.sc = f.c GROUP BY p.tile, p.r, p.c, dist""",
    "search_setup": f"SELECT id, ground, height, reach FROM {_setup()}",
    "dem_around_point": f"""WITH s AS (SELECT * FROM {_setup()}), g AS (SELECT tile // {ACROSS} * {_N} + r AS ar, tile % {ACROSS} * {_N} + c AS ac, h FROM {_F})
 SELECT id, count(*) AS n, cast(sum(h) AS bigint) AS sum_h, cast(min(ar - gr + reach) AS int) AS r_min, cast(max(ar - gr + reach) AS int) AS r_max, cast(min(ac - gc + reach) AS int) AS c_min, cast(max(ac - gc + reach) AS int) AS c_max,
 min(h) AS h_min, max(h) AS h_max FROM s JOIN g ON ar BETWEEN gr - reach AND gr + reach AND ac BETWEEN gc - reach AND gc + reach GROUP BY id""",
    "dem_squared": f"""SELECT tile, count(*) AS n, cast(sum(h) AS bigint) AS sum_h, 90.0::DOUBLE AS side, round(1.0::DOUBLE / (max(x.t) + 1), 9) AS degrees FROM {_F} f JOIN {_axis(_N)} y ON f.r = y.a JOIN {_axis(22)} x ON f.c = x.a GROUP BY tile""",
    "agl_image": _image(f"h - {ABOVE}", "greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN high = greatest(low, 20) THEN NULL ELSE (v - greatest(low, 20::DOUBLE)) / (high - greatest(low, 20::DOUBLE)) END))"),
    "height_image": _image(f"CASE WHEN h > {ABOVE} THEN h ELSE 0 END", "CASE WHEN high = low THEN NULL ELSE (v - low) / (high - low) END"),
    "dem_mosaic": f"""SELECT cast(((tile // 5) * {_N} + r) // 8 AS int) AS br, cast(((tile % 5) * {_N} + c) // 8 AS int) AS bc, count(*) AS n, cast(sum(h) AS bigint) AS sum_h FROM {_F} GROUP BY 1, 2""",
    "kml_corners": f"SELECT * FROM {_CORNER}",
    "point_in_cell": f"""SELECT cast(greatest(0, least(19, floor((lat - 44.0::DOUBLE) / 4.0::DOUBLE * 20))) AS int) AS r, cast(greatest(0, least(39, floor((lon - 6.0::DOUBLE) / 8.0::DOUBLE * 40))) AS int) AS c, count(*) AS n
 FROM {I.SITES} WHERE lat BETWEEN 44 AND 48 AND lon BETWEEN 6 AND 14 GROUP BY 1, 2""",
    "dem_point_lookup": f"""SELECT id, tile, r, c, h FROM (SELECT id, cast(gr // {_N} * {ACROSS} + gc // {_N} AS bigint) AS tile, cast(gr % {_N} AS int) AS r, cast(gc % {_N} AS int) AS c FROM (SELECT id,
 cast(greatest(0, least({ROWS * _N - 1}, floor((lat - 44.0::DOUBLE) / 4.0::DOUBLE * {ROWS * _N}))) AS int) AS gr,
 cast(greatest(0, least({ACROSS * _N - 1}, floor((lon - 6.0::DOUBLE) / 8.0::DOUBLE * {ACROSS * _N}))) AS int) AS gc FROM {I.SITES} WHERE lat BETWEEN 44 AND 48 AND lon BETWEEN 6 AND 14)) JOIN {_F} USING (tile, r, c)""",
    "grid_rasters": f"""SELECT f.tile, f.r, f.c, cast(coalesce(trunc(nh) - h, -1000) AS int) AS agl, cast(coalesce(trunc(nh), -1000) AS int) AS height FROM {_F} f
 LEFT JOIN (SELECT r, c, max(h) AS nh FROM {I.TREE} GROUP BY r, c) n ON f.r = n.r AND f.c = n.c""",
    "kml_placemarks": f"""SELECT tile, r, c, concat('<Placemark><name>', r, '_', c, '</name><Style><PolyStyle><color>', printf('96%02x%02x%02x', {_channel(2)}, {_channel(1)}, {_channel(0)}), '</color></PolyStyle></Style><Polygon><coordinates>', c, ',', r, ',', h, ' ', c + 1, ',', r, ',', h_right, ' ', c + 1, ',', r + 1, ',', h_diag, ' ', c, ',', r + 1, ',', h_up, '</coordinates></Polygon></Placemark>') AS kml,
 printf('96%02x%02x%02x', {_channel(2)}, {_channel(1)}, {_channel(0)}) AS colour FROM (SELECT *, (h - {ABOVE}) / {1300 - ABOVE}::DOUBLE AS s FROM {_CORNER} WHERE h > {ABOVE})""",
}
