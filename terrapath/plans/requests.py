"""Queries on requests: searches made once each, their rasters, grids with metadata, and searches that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flight as L
from ..operators import raster as R
from ..operators import requests as Q
from ..shared import new_path, written
from . import inputs as I
from .paths import _GROUND, _STARTS, _reach_sql, _reached, _starts
from .paths import ACROSS, CELL_M, GLIDE, NEAR_FROM, NEAR_M

#: Ids of searches that go on are those of the first ones, and this more.
ON = 1_000_000
#: The mosaic's corner and the degrees of its cells.
CORNER, DEGREES = (43.0, 5.0), (0.0018, 0.0026)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per supplier, three alike each; some bring a start height."""
    asked = I.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS request_id", "s_suppkey div 3 AS k")
    k = F.col("k")
    return asked.select(
        "request_id", (F.floor(k / ACROSS) * I.SIDE + 8 + k % 16).cast("int").alias("gr"), (k % ACROSS * I.SIDE + 8 + k * 5 % 16).cast("int").alias("gc"),
        F.when(k % 2 == 0, (1000 + k % 5 * 50).cast("double")).alias("start_height"), (200 + k % 7 * 40).cast("double").alias("additional_height"),
        F.lit(NEAR_M).alias("safety_margin"), F.lit(NEAR_FROM).alias("start_distance"), F.when(k % 3 > 0, 1 / GLIDE).alias("glide_number"),
    )


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fill_voids(I.dem(spark, sf_dir), ("tile",))


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    asked, cells, store = _requests(spark, sf_dir), _filled(spark, sf_dir), new_path(spark, "searches")
    Q.search_once(asked, cells, I.SIDE, ACROSS, CELL_M, store)
    return asked, cells, store


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request's raster looks like; requests alike share a search."""
    asked, _, store = _searched(spark, sf_dir)
    return Q.answers(asked, store)


def request_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rasters of all requests: heights, heights above ground, margin."""
    asked, cells, store = _searched(spark, sf_dir)
    found = Q.rasters(asked, cells, I.SIDE, ACROSS, store)
    return found.select("request_id", "r", "c", F.round("height", 4).alias("height"), F.round("agl", 4).alias("agl"), "near")


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid per supplier; some say how far and how fine."""
    k = F.col("s_suppkey")
    asked = I.table(spark, sf_dir, "supplier").select(
        k.alias("request_id"), (F.floor(k / ACROSS) * I.SIDE + k % I.SIDE).cast("int").alias("gr"), (k % ACROSS * I.SIDE + k * 7 % I.SIDE).cast("int").alias("gc"),
        F.when(k % 4 > 0, (k % 4 * 1700).cast("double")).alias("margin_m"), F.when(k % 3 > 0, (150 * (k % 3)).cast("double")).alias("cell_size"),
    )
    down = (I.table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] or 0) // ACROSS + 1
    return Q.grids(asked, I.SIDE, ACROSS, int(down), CELL_M, CORNER, DEGREES)


def request_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heights of each request's grid."""
    return Q.grid_heights(_grids(spark, sf_dir), _filled(spark, sf_dir), I.SIDE, ACROSS)


def request_grid_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each grid's shape, cell sizes, middle and box."""
    metas = _grids(spark, sf_dir)
    found = Q.grid_metadata(metas, Q.middle_heights(metas, _filled(spark, sf_dir), I.SIDE, ACROSS))
    return found.select(*(c for c in found.columns if c not in ("south", "west", "north", "east")), *(F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")))


def grid_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation tiles of which some lack cells, repeat one or have one too many, against their shape."""
    tiles = I.dem(spark, sf_dir).select("tile", "r", "c", "h")
    kept = tiles.filter(~((F.col("tile") % 4 == 1) & (F.col("r") == F.col("c"))))
    more = tiles.filter((F.col("tile") % 6 == 2) & (F.col("r") == 3)).unionByName(tiles.filter((F.col("tile") % 5 == 3) & (F.col("c") == 0)).withColumn("c", F.lit(I.SIDE)))
    shapes = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile"), F.lit(I.SIDE).alias("rows"), F.lit(I.SIDE).alias("cols"))
    return Q.grid_faults(shapes, kept.unionByName(more), "tile")


def glide_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way back from the farthest node of a search that went on, 60 m higher, from the farthest node of another, over both."""
    first = written(_reached(spark, sf_dir, _starts(spark, sf_dir)), "first")

    def farthest(nodes: DataFrame) -> DataFrame:
        return nodes.groupBy("search_id").agg(F.max_by(F.struct("gr", "gc"), F.struct("dist", "gr", "gc")).alias("x")).select("search_id", "x.gr", "x.gc")

    picks = farthest(first).select((F.col("search_id") + ON).alias("search_id"), F.col("search_id").alias("from_search"), "gr", "gc")
    starts = written(Q.continued(first, picks).withColumn("height", F.col("height") + 60.0), "continued")
    second = written(_reached(spark, sf_dir, starts), "second")
    path = Q.way_back(first.unionByName(second), starts, farthest(second))
    return path.select(F.col("target.search_id").alias("search_id"), "depth", F.col("id.search_id").alias("in_search"), F.col("id.gr").alias("gr"), F.col("id.gc").alias("gc"))


def leg_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each leg of the tree loses under a wind from the south-west, and the margin that holds at its end."""
    tree = I.tree(spark, sf_dir)
    up = tree.select(F.col("id").alias("parent"), F.col("r").alias("r0"), F.col("c").alias("c0"))
    legs = tree.join(up, "parent")
    angle = L.wind_angle(F.radians(F.lit(225.0)), F.col("r0") - F.col("r"), F.col("c0") - F.col("c"))
    lost = L.grid_distance(F.col("r"), F.col("c"), F.col("r0"), F.col("c0")) * 100.0 * L.effective_glide(F.lit(GLIDE), F.lit(38.0), F.lit(12.0), angle)
    return legs.select("id", F.round(lost, 6).alias("lost"), L.margin_at(F.col("dist"), F.lit(NEAR_M), F.lit(300)).alias("margin"))


QUERIES = (request_answers, request_rasters, request_grids, request_grid_metadata, grid_faults, glide_continue, leg_losses)

_ASKED = f"""q AS (SELECT s_suppkey AS request_id, s_suppkey // 3 AS k FROM supplier), p AS (SELECT request_id, k, k // {ACROSS} * {I.SIDE} + 8 + k % 16 AS gr, k % {ACROSS} * {I.SIDE} + 8 + k * 5 % 16 AS gc FROM q),
 one AS (SELECT DISTINCT k AS search_id, gr, gc, h AS ground, greatest(CASE WHEN k % 2 = 0 THEN (1000 + k % 5 * 50)::DOUBLE ELSE h + (200 + k % 7 * 40)::DOUBLE END, h::DOUBLE) AS height FROM p JOIN g USING (gr, gc))"""
_ANSWERS = f"""WITH RECURSIVE {_GROUND}, {_ASKED}, {_reach_sql('w', 'one')},
 box AS (SELECT search_id, count(*) AS n, min(gr) AS r0, max(gr) AS r1, min(gc) AS c0, max(gc) AS c1 FROM w_end GROUP BY search_id)"""
_FAR = "SELECT search_id, arg_max({'gr': gr, 'gc': gc}, {'d': d, 'gr': gr, 'gc': gc}) AS x FROM"
_GRIDS = f"""a AS (SELECT s_suppkey AS request_id, s_suppkey // {ACROSS} * {I.SIDE} + s_suppkey % {I.SIDE} AS gr, s_suppkey % {ACROSS} * {I.SIDE} + s_suppkey * 7 % {I.SIDE} AS gc,
 cast(floor(greatest(1000.0::DOUBLE, least(300000.0::DOUBLE, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 * 1700.0::DOUBLE ELSE 15000.0::DOUBLE END)) / {CELL_M}::DOUBLE) AS int) AS reach,
 greatest({CELL_M}::DOUBLE, CASE WHEN s_suppkey % 3 > 0 THEN 150.0::DOUBLE * (s_suppkey % 3) ELSE 0.0::DOUBLE END) AS cell_size, (SELECT max(s_suppkey) // {ACROSS} + 1 FROM supplier) AS down FROM supplier),
 b AS (SELECT *, greatest(0, gr - reach) AS r0, least(down * {I.SIDE} - 1, gr + reach) AS r1, greatest(0, gc - reach) AS c0, least({ACROSS * I.SIDE - 1}, gc + reach) AS c1 FROM a),
 m AS (SELECT *, r1 - r0 + 1 AS n_r, c1 - c0 + 1 AS n_c, cast(ceil((r1 - r0 + 1) * ({CELL_M}::DOUBLE / cell_size)) AS int) AS rows, cast(ceil((c1 - c0 + 1) * ({CELL_M}::DOUBLE / cell_size)) AS int) AS cols FROM b),
 x AS (SELECT request_id, cast(tr AS int) AS r, cast(tc AS int) AS c, h FROM m, unnest(range(0, rows)) u(tr), unnest(range(0, cols)) v(tc), g
 WHERE g.gr = r0 + cast(round(tr * ((n_r - 1) / greatest(rows - 1, 1)::DOUBLE)) AS int) AND g.gc = c0 + cast(round(tc * ((n_c - 1) / greatest(cols - 1, 1)::DOUBLE)) AS int))"""
SQL = {
    "request_answers": f"""{_ANSWERS} SELECT request_id, cast(r1 - r0 + 1 AS int) AS rows, cast(c1 - c0 + 1 AS int) AS cols, cast(one.gr - r0 AS int) AS start_r, cast(one.gc - c0 AS int) AS start_c,
 ground::DOUBLE AS ground, height AS start_height, n FROM p JOIN one ON p.k = one.search_id JOIN box USING (search_id)""",
    "request_rasters": f"""{_ANSWERS}, every AS (SELECT search_id, r0, c0, unnest(range(r0, r1 + 1)) AS gr, c1 FROM box), cells AS (SELECT search_id, r0, c0, gr, unnest(range(c0, c1 + 1)) AS gc FROM every)
 SELECT request_id, cast(x.gr - r0 AS int) AS r, cast(x.gc - c0 AS int) AS c, round(coalesce(w.h, -1000.0::DOUBLE), 4) AS height, round(coalesce(w.h - g.h, -1000.0::DOUBLE), 4) AS agl, coalesce(near, false) AS near
 FROM p JOIN cells x ON p.k = x.search_id LEFT JOIN w_end w ON w.search_id = x.search_id AND w.gr = x.gr AND w.gc = x.gc LEFT JOIN g ON g.gr = w.gr AND g.gc = w.gc""",
    "request_grids": f"WITH {_GROUND}, {_GRIDS} SELECT request_id, r, c, h FROM x",
    "request_grid_metadata": f"""WITH {_GROUND}, {_GRIDS} SELECT m.request_id, rows, cols, cell_size, {CELL_M}::DOUBLE AS min_cell_size, cast(rows // 2 AS int) AS start_r, cast(cols // 2 AS int) AS start_c, x.h AS start_height,
 round({CORNER[0]}::DOUBLE + r0 * {DEGREES[0]}::DOUBLE, 6) AS south, round({CORNER[1]}::DOUBLE + c0 * {DEGREES[1]}::DOUBLE, 6) AS west, round({CORNER[0]}::DOUBLE + (r0 + n_r) * {DEGREES[0]}::DOUBLE, 6) AS north,
 round({CORNER[1]}::DOUBLE + (c0 + n_c) * {DEGREES[1]}::DOUBLE, 6) AS east FROM m LEFT JOIN x ON x.request_id = m.request_id AND x.r = rows // 2 AND x.c = cols // 2""",
    "grid_faults": f"""WITH d AS (SELECT tile, r, c FROM {I.DEM}), e AS (SELECT * FROM d WHERE NOT (tile % 4 = 1 AND r = c) UNION ALL SELECT * FROM d WHERE tile % 6 = 2 AND r = 3
 UNION ALL SELECT tile, r, {I.SIDE} FROM d WHERE tile % 5 = 3 AND c = 0), n AS (SELECT tile, c < {I.SIDE} AS fits, count(*) AS times FROM e GROUP BY tile, r, c),
 t AS (SELECT tile, {I.SIDE * I.SIDE}::BIGINT AS wanted, count(*) FILTER (fits) AS inside, count(*) FILTER (NOT fits) AS outside, count(*) FILTER (times > 1) AS repeated FROM n GROUP BY tile)
 SELECT *, CASE WHEN outside > 0 THEN 'outside' WHEN repeated > 0 THEN 'repeated' WHEN inside < wanted THEN 'missing' END AS fault FROM t""",
    "glide_continue": f"""WITH RECURSIVE {_GROUND}, {_reach_sql('w', _STARTS)}, f AS MATERIALIZED ({_FAR} w_end GROUP BY search_id),
 s AS MATERIALIZED (SELECT f.search_id + {ON} AS search_id, f.search_id AS from_search, w.gr, w.gc, w.h + 60.0::DOUBLE AS height FROM f JOIN w_end w ON w.search_id = f.search_id AND w.gr = f.x.gr AND w.gc = f.x.gc),
 {_reach_sql('v', 's')}, nodes AS MATERIALIZED (SELECT search_id, gr, gc, search_id AS up, pr, pc FROM w_end UNION ALL
 SELECT v.search_id, v.gr, v.gc, CASE WHEN pr IS NULL THEN from_search ELSE v.search_id END, coalesce(pr, v.gr), coalesce(pc, v.gc) FROM v_end v JOIN s ON s.search_id = v.search_id),
 walk AS (SELECT search_id, 0 AS depth, search_id AS in_search, x.gr AS gr, x.gc AS gc FROM ({_FAR} v_end GROUP BY search_id)
 UNION ALL SELECT t.search_id, t.depth + 1, n.up, n.pr, n.pc FROM walk t JOIN nodes n ON n.search_id = t.in_search AND n.gr = t.gr AND n.gc = t.gc WHERE n.pr IS NOT NULL)
 SELECT search_id, depth, in_search, cast(gr AS int) AS gr, cast(gc AS int) AS gc FROM walk""",
    "leg_losses": f"""WITH t AS (SELECT * FROM {I.TREE}), l AS (SELECT t.id, t.dist, u.r - t.r AS dr, u.c - t.c AS dc FROM t JOIN t u ON t.parent = u.id),
 a AS (SELECT *, pi() / 2 - radians(225.0::DOUBLE) - atan2(dr::DOUBLE, dc::DOUBLE) AS a FROM l), b AS (SELECT *, 38.0::DOUBLE * 38.0::DOUBLE - (sin(a) * 12.0::DOUBLE) * (sin(a) * 12.0::DOUBLE) AS lft, cos(a) * 12.0::DOUBLE AS along FROM a)
 SELECT id, round(sqrt((dr * dr + dc * dc)::DOUBLE) * 100.0::DOUBLE * ({GLIDE}::DOUBLE / ((sqrt(lft) + along) / 38.0::DOUBLE)), 6) AS lost, CASE WHEN dist < 300 THEN 0.0::DOUBLE ELSE {NEAR_M}::DOUBLE END AS margin FROM b""",
}
