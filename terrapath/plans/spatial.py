"""Queries on points, boxes and stored windows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import spatial as S
from . import inputs as I

BOX = (45.0, 9.0, 46.5, 12.0)
AT = (10.0, 46.0)
VIEW = (44.0, 7.0, 45.5, 9.5)
WITHIN_M = 25_000.0


def bbox_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.in_box(I.sites(spark, sf_dir), BOX).select("id", "name", "lon", "lat")


def bbox_nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of a box nearest to its middle."""
    inside = S.in_box(I.sites(spark, sf_dir), BOX)
    near = S.nearest_k(inside, (BOX[1] + BOX[3]) / 2, (BOX[0] + BOX[2]) / 2, 50)
    return near.select("id", "name", F.round("metres", 3).alias("metres"))


def usage_sites_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites nearest to a point, anywhere, by true distance; the compatible measure orders alike."""
    near = S.nearest_k(I.sites(spark, sf_dir), *AT, 20)
    return near.select("id", F.round("metres", 3).alias("metres"), F.round(G.haversine_compat(F.lit(AT[0]), F.lit(AT[1]), "lon", "lat"), 3).alias("compat"))


def nearest_site_per_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window's corner the nearest site within a distance."""
    points = I.windows(spark, sf_dir).select(F.col("box_id").alias("point_id"), F.col("west").alias("plon"), F.col("south").alias("plat"))
    return S.nearest_site(points, I.sites(spark, sf_dir), WITHIN_M).select("point_id", "id", F.round("metres", 3).alias("metres"))


def smallest_covering_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = I.sites(spark, sf_dir).select(
        F.col("id").alias("want_id"), (F.col("lat") - 0.05).alias("w_south"), (F.col("lon") - 0.05).alias("w_west"),
        (F.col("lat") + 0.05).alias("w_north"), (F.col("lon") + 0.05).alias("w_east"),
    )
    return S.smallest_cover(wanted, I.windows(spark, sf_dir))


def best_height_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = I.sites(spark, sf_dir).select("id", "lon", "lat")
    return S.best_map(points, I.windows(spark, sf_dir), 60.5)


def dedupe_sites_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sites_in_view(VIEW, I.windows(spark, sf_dir), I.sites(spark, sf_dir))


def covered_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.covered(I.sites(spark, sf_dir), I.windows(spark, sf_dir)).select("id", "kind")


def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance and discrete median per dimension, and whether it is the widest one."""
    long = I.sites(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("lon").alias("dim"), F.col("lon").alias("v")), F.struct(F.lit("lat").alias("dim"), F.col("lat").alias("v")))).alias("x"))
    stats = long.groupBy("x.dim").agg(F.var_pop("x.v").alias("variance"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x.v)").alias("median"))
    widest = F.row_number().over(Window.orderBy(F.desc("variance"), "dim")) == 1  # two rows
    return stats.select("dim", F.round("variance", 6).alias("variance"), F.round("median", 6).alias("median"), widest.alias("widest"))


def grid_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arc seconds, grid lines, margins and bounds around each site."""
    s, w, n, e = G.bounds_around("lat", "lon", F.lit(12_000.0))
    at = G.coordinate_to_index("lat", 600, 43.0, 49.0)
    return I.sites(spark, sf_dir).select(
        "id", F.round(G.arcsecond_m("lat"), 6).alias("arcsecond_m"), F.round(G.metres_in_arcseconds("lat"), 6).alias("per_m"), at.alias("row"),
        F.round(G.index_to_coordinate(at, 600, 43.0, 49.0), 6).alias("line_lat"), F.round(G.cell_centre(at, 600, 43.0, 49.0), 6).alias("centre_lat"),
        G.search_margin_m(F.col("id") * 13, F.lit(8.0)).alias("margin_m"), F.round(s, 6).alias("south"), F.round(w, 6).alias("west"), F.round(n, 6).alias("north"), F.round(e, 6).alias("east"),
        G.hgt_name(F.floor("lat").cast("int"), F.floor("lon").cast("int")).alias("tile_name"),
    )


def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of name and place per site, with the areas of the windows that hold it."""
    sites = I.sites(spark, sf_dir)
    key = F.concat_ws("_", "name", F.col("lon").cast("decimal(9,3)").cast("string"), F.col("lat").cast("decimal(9,3)").cast("string"))
    held = sites.join(S.place_windows(I.windows(spark, sf_dir), sites), ["lon", "lat"])
    return held.groupBy(key.alias("key")).agg(F.sum("n_windows").alias("n_windows"), F.round(F.min("least_area"), 6).alias("least_area"))


QUERIES = (
    bbox_sites, bbox_nearest_k, usage_sites_topk, nearest_site_per_point, smallest_covering_window, best_height_map,
    dedupe_sites_in_windows, covered_sites, dimension_stats, grid_geometry, composite_key,
)


def _hav(lon1: str, lat1: str, lon2: str, lat2: str, root: bool = True) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {G.EARTH_RADIUS_M} * atan2({f'sqrt({a})' if root else a}, sqrt(1 - {a})))"


def _in(box: tuple) -> str:
    return f"lat BETWEEN {box[0]} AND {box[2]} AND lon BETWEEN {box[1]} AND {box[3]}"


_MID = (f"{(BOX[1] + BOX[3]) / 2}::DOUBLE", f"{(BOX[0] + BOX[2]) / 2}::DOUBLE")
_PT = (f"{AT[0]}::DOUBLE", f"{AT[1]}::DOUBLE")
_HOLDS = "lat BETWEEN south AND north AND lon BETWEEN west AND east"
_AREA = "abs((north - south) * (east - west))"
_COS = "greatest(cos(radians(lat)), 0.05::DOUBLE)"
SQL = {
    "bbox_sites": f"SELECT id, name, lon, lat FROM {I.SITES} WHERE {_in(BOX)}",
    "bbox_nearest_k": f"SELECT id, name, round(m, 3) AS metres FROM (SELECT *, {_hav(*_MID, 'lon', 'lat')} AS m FROM {I.SITES} WHERE {_in(BOX)}) ORDER BY m, id LIMIT 50",
    "usage_sites_topk": f"SELECT id, round(m, 3) AS metres, round(k, 3) AS compat FROM (SELECT *, {_hav(*_PT, 'lon', 'lat')} AS m, {_hav(*_PT, 'lon', 'lat', False)} AS k FROM {I.SITES}) ORDER BY m, id LIMIT 20",
    "nearest_site_per_point": f"""SELECT point_id, id, round(m, 3) AS metres FROM (SELECT w.box_id AS point_id, s.id, {_hav('w.west', 'w.south', 's.lon', 's.lat')} AS m,
 row_number() OVER (PARTITION BY w.box_id ORDER BY {_hav('w.west', 'w.south', 's.lon', 's.lat')}, s.id) AS k FROM {I.WINDOWS} w, {I.SITES} s WHERE {_hav('w.west', 'w.south', 's.lon', 's.lat')} <= {WITHIN_M}) WHERE k = 1""",
    "smallest_covering_window": f"""SELECT want_id, box_id FROM (SELECT s.id AS want_id, w.box_id, row_number() OVER (PARTITION BY s.id ORDER BY {_AREA}, box_id) AS k FROM {I.SITES} s JOIN {I.WINDOWS} w
 ON south <= lat - 0.05 AND north >= lat + 0.05 AND west <= lon - 0.05 AND east >= lon + 0.05) WHERE k = 1""",
    "best_height_map": f"""SELECT id, box_id FROM (SELECT id, box_id, row_number() OVER (PARTITION BY id ORDER BY round(abs(grid - 60.5), 3), {_AREA}, box_id) AS k
 FROM {I.SITES} s JOIN {I.WINDOWS} w ON {_HOLDS} WHERE abs(grid - 60.5) <= greatest(1.0, 60.5 * 0.03)) WHERE k = 1""",
    "dedupe_sites_in_windows": f"""SELECT min(id) AS id, name, lon, lat FROM {I.SITES} s JOIN (SELECT * FROM {I.WINDOWS} WHERE south <= {VIEW[2]} AND north >= {VIEW[0]} AND west <= {VIEW[3]} AND east >= {VIEW[1]}) w
 ON {_HOLDS} WHERE {_in(VIEW)} GROUP BY name, lon, lat""",
    "covered_sites": f"SELECT id, kind FROM {I.SITES} s WHERE EXISTS (SELECT 1 FROM {I.WINDOWS} w WHERE {_HOLDS})",
    "dimension_stats": f"""WITH x AS (SELECT 'lon' AS dim, lon AS v FROM {I.SITES} UNION ALL SELECT 'lat', lat FROM {I.SITES}),
 y AS (SELECT dim, var_pop(v) AS var, quantile_disc(v, 0.5) AS med FROM x GROUP BY dim)
 SELECT dim, round(var, 6) AS variance, round(med, 6) AS median, row_number() OVER (ORDER BY var DESC, dim) = 1 AS widest FROM y""",
    "grid_geometry": f"""SELECT id, round(cos(radians(lat)) * 1852.0::DOUBLE / 60, 6) AS arcsecond_m, round(1 / (cos(radians(lat)) * 1852.0::DOUBLE / 60), 6) AS per_m, row,
 round(43.0::DOUBLE + 6.0::DOUBLE * row / 599, 6) AS line_lat, round(43.0::DOUBLE + (row + 0.5::DOUBLE) / 600 * 6.0::DOUBLE, 6) AS centre_lat,
 cast(round(greatest(5000.0, least(120000.0, id * 13 * 8.0))) AS bigint) AS margin_m,
 round(lat - 12000.0::DOUBLE / 111320.0::DOUBLE, 6) AS south, round(lon - 12000.0::DOUBLE / (111320.0::DOUBLE * {_COS}), 6) AS west,
 round(lat + 12000.0::DOUBLE / 111320.0::DOUBLE, 6) AS north, round(lon + 12000.0::DOUBLE / (111320.0::DOUBLE * {_COS}), 6) AS east,
 printf('N%02dE%03d.hgt', cast(floor(lat) AS int), cast(floor(lon) AS int)) AS tile_name
 FROM (SELECT *, cast(greatest(0, least(599, floor((lat - 43.0::DOUBLE) / 6.0::DOUBLE * 600))) AS int) AS row FROM {I.SITES})""",
    "composite_key": f"""SELECT concat_ws('_', name, cast(cast(lon AS decimal(9,3)) AS varchar), cast(cast(lat AS decimal(9,3)) AS varchar)) AS key, count(*) AS n_windows, round(min({_AREA}), 6) AS least_area
 FROM {I.SITES} JOIN {I.WINDOWS} ON {_HOLDS} GROUP BY 1""",
}
