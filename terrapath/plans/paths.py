"""Queries on trees of path nodes and on glides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flight as L
from ..operators import paths as P
from ..operators import raster as R
from ..operators.reach import reach
from . import inputs as I


#: Margin above ground of the series, and the distance from which it holds.
MARGIN, START = 1800.0, 100.0
#: Tiles of a row of the mosaic.
ACROSS = 5


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the tree."""
    tree = I.tree(spark, sf_dir)
    return tree.join(tree.select(F.col("parent").alias("id")).distinct().hint("merge"), "id", "left_anti").select("id")


def path_backtrace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.backtrace(I.tree(spark, sf_dir), _targets(spark, sf_dir))


def path_backtrace_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = P.backtrace_sql(I.tree(spark, sf_dir), _targets(spark, sf_dir))
    return walk.groupBy("target").agg(F.max("depth").alias("legs"), F.sum("id").alias("sum_id"))


def path_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.backtrace(I.tree(spark, sf_dir), _targets(spark, sf_dir))
    return P.profile(path, I.tree(spark, sf_dir)).select("target", "depth", "i", "r", "c", F.round("h", 6).alias("h"))


def _leg_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each node's leg with the ground below them."""
    ground = R.mosaic(R.fill_voids(I.dem(spark, sf_dir), ("tile",)), I.SIDE, 5).select(F.col("gr").alias("r"), F.col("gc").alias("c"), F.col("h").alias("ground"))
    return P.series(P.legs(I.tree(spark, sf_dir)), ground, MARGIN, START)


def path_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each path with the ground below them, on tiles laid side by side in rows of five."""
    found = P.along(P.backtrace(I.tree(spark, sf_dir), _targets(spark, sf_dir)), _leg_series(spark, sf_dir))
    return found.select("target", "depth", "i", "ground", *(F.round(x, 6).alias(x) for x in ("dist", "agl", "floor")))


def path_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each path first comes into the margin above ground: its legs are looked at once each, whatever paths take them."""
    legs = P.margin_violations(_leg_series(spark, sf_dir), MARGIN, START, "id")
    found = P.worst_of_legs(P.along(P.backtrace(I.tree(spark, sf_dir), _targets(spark, sf_dir)), legs))
    return found.select("target", *(F.round(x, 6).alias(x) for x in ("agl_min", "agl_max", "first_in_margin")))


def profile_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of each path's heights, the compass sector of its last leg and its length for display."""
    tree = I.tree(spark, sf_dir)
    path = P.backtrace(tree, _targets(spark, sf_dir))
    at = path.join(tree.select("id", "r", "c", "h", "dist").hint("merge"), "id")
    last = at.groupBy("target").agg(
        F.min("h").alias("h_min"), F.max("h").alias("h_max"), F.max("depth").alias("legs"),
        *(F.min_by(x, "depth").alias(f"{x}0") for x in ("r", "c", "dist")),
        *(F.max(F.when(F.col("depth") == 1, F.col(x))).alias(f"{x}1") for x in ("r", "c")),
    )
    return last.select(
        "target", "h_min", "h_max", "legs", L.compass_sector(F.col("r0") - F.col("r1"), F.col("c0") - F.col("c1")).alias("sector"), F.round(F.col("dist0") / 1000, 1).alias("km"),
    )


def glide_reduced_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reduced_stream(I.tree(spark, sf_dir))


def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.tree(spark, sf_dir).select("id", F.expr("id div 1000").alias("g"), F.expr("id div 40").alias("ref"))
    return P.delta_encode(rows, "g", "id", "ref")


def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.delta_decode(delta_encode(spark, sf_dir), "g", "id", "ref")


def glide_cone_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes re-indexed to the corner of their bounding box."""
    return P.crop_to_nodes(I.tree(spark, sf_dir).filter("r between 20 and 80 and c between 10 and 70"))


def effective_glide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glide under wind for each part, -1 where the wind wins."""
    k = F.col("p_partkey")
    angle, wind = (k % 16) * (math.pi / 8), (k % 50).cast("double")
    g = L.effective_glide(F.lit(0.125), F.lit(38.0), wind, angle)
    return I.table(spark, sf_dir, "part").select("p_partkey", F.round(F.when(g == math.inf, -1.0).otherwise(g), 6).alias("glide"))


#: What the searches of ``glide_reach`` have in common: cell side, glide, margin and where it begins.
CELL_M, GLIDE, NEAR_M, NEAR_FROM = 200.0, 0.125, 40.0, 600.0


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per tile, from near its middle, over tiles laid side by side in rows of five."""
    k = F.col("s_suppkey")
    return I.table(spark, sf_dir, "supplier").select(
        k.alias("search_id"), (F.floor(k / ACROSS) * I.SIDE + 8 + k % 16).cast("int").alias("gr"), (k % ACROSS * I.SIDE + 8 + k * 5 % 16).cast("int").alias("gc"), (1000 + k % 5 * 50).cast("double").alias("height")
    )


def _reached(spark: SparkSession, sf_dir: str, starts: DataFrame) -> DataFrame:
    return reach(R.fill_voids(I.dem(spark, sf_dir), ("tile",)), starts, I.SIDE, ACROSS, CELL_M, glide=GLIDE, margin=NEAR_M, start_distance=NEAR_FROM)


def glide_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell that a glide from the middle of each tile reaches by straight legs, with the last leg's begin and class."""
    nodes = _reached(spark, sf_dir, _starts(spark, sf_dir))
    return nodes.select("search_id", "gr", "gc", F.round("height", 4).alias("height"), F.round("dist", 4).alias("dist"), "ref_gr", "ref_gc", F.when(F.col("near"), "margin").otherwise("clear").alias("state"))


def glide_reach_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, box and lowest height of each search."""
    return glide_reach(spark, sf_dir).groupBy("search_id").agg(
        F.count("*").alias("n"), F.min("gr").alias("r_min"), F.max("gr").alias("r_max"), F.min("gc").alias("c_min"), F.max("gc").alias("c_max"), F.min("height").alias("lowest")
    )


QUERIES = (
    path_backtrace, path_backtrace_sql, path_profile, path_series, path_margin, profile_minmax, glide_reduced_stream, delta_encode, delta_decode, glide_cone_bounds,
    effective_glide_table, glide_reach, glide_reach_bounds,
)

_WALK = f"""WITH RECURSIVE t AS (SELECT * FROM {I.TREE}), walk AS (SELECT id AS target, 0 AS depth, id FROM t WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)
 UNION ALL SELECT w.target, w.depth + 1, t.parent FROM walk w JOIN t ON w.id = t.id WHERE t.parent IS NOT NULL)"""
_SERIES = f"""{_WALK}, a AS (SELECT target, depth, r, c, h, dist, lead(r) OVER w AS r2, lead(c) OVER w AS c2, lead(h) OVER w AS h2, lead(dist) OVER w AS dist2 FROM walk JOIN t USING (id) WINDOW w AS (PARTITION BY target ORDER BY depth DESC)),
 b AS (SELECT *, cast(greatest(1, ceil(sqrt((r2 - r) * (r2 - r) + (c2 - c) * (c2 - c)))) AS int) AS n FROM a WHERE r2 IS NOT NULL), s AS (SELECT *, unnest(range(0, n)) AS i FROM b),
 u AS (SELECT target, depth, cast(i AS int) AS i, cast(round(r + (r2 - r) * (i / greatest(n - 1, 1)::DOUBLE)) AS int) AS r, cast(round(c + (c2 - c) * (i / greatest(n - 1, 1)::DOUBLE)) AS int) AS c,
 h + (h2 - h) * (i / greatest(n - 1, 1)::DOUBLE) AS h, dist + (dist2 - dist) * (i / greatest(n - 1, 1)::DOUBLE) AS dist FROM s),
 g AS (SELECT tile // 5 * {I.SIDE} + r AS r, tile % 5 * {I.SIDE} + c AS c, last_value(CASE WHEN h >= -1000 THEN h END IGNORE NULLS) OVER (PARTITION BY tile ORDER BY r, c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ground FROM {I.DEM}),
 z AS (SELECT u.*, ground, h - ground AS agl, CASE WHEN dist >= {START} THEN h - {MARGIN} END AS floor FROM u JOIN g USING (r, c))"""
_SECT = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
_GROUND = f"""g AS MATERIALIZED (SELECT tile // {ACROSS} * {I.SIDE} + r AS gr, tile % {ACROSS} * {I.SIDE} + c AS gc,
 last_value(CASE WHEN h >= -1000 THEN h END IGNORE NULLS) OVER (PARTITION BY tile ORDER BY r, c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM {I.DEM}),
 steps AS (SELECT dr, dc FROM range(-1, 2) a(dr), range(-1, 2) b(dc) WHERE dr <> 0 OR dc <> 0)"""
_STARTS = f"""(SELECT s_suppkey AS search_id, s_suppkey // {ACROSS} * {I.SIDE} + 8 + s_suppkey % 16 AS gr, s_suppkey % {ACROSS} * {I.SIDE} + 8 + s_suppkey * 5 % 16 AS gc, (1000 + s_suppkey % 5 * 50)::DOUBLE AS height FROM supplier)"""
#: Rounds after which no cell of the test tables changes any more; each round, all cells take their neighbours' best offers anew.
_ROUNDS = 70


def _reach_sql(name: str, starts: str) -> str:
    """Tables ``name`` (all rounds) and ``name_end``: the rules of the reach, applied to all cells at once again and again. Needs g and steps."""
    take = "along AND straight >= h AND straight < y_h"
    bend = "bend >= h AND bend < y_h"
    return f"""{name}_0 AS MATERIALIZED (SELECT s.* FROM {starts} s JOIN g USING (gr, gc) WHERE height >= h),
 {name}(t, search_id, gr, gc, h, d, pr, pc, hp, dp, near) AS (SELECT 0, search_id, gr, gc, height, 0.0::DOUBLE, NULL::BIGINT, NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, false FROM {name}_0
 UNION ALL (SELECT t, search_id, gr, gc, x.h, x.d, x.pr, x.pc, x.hp, x.dp, x.near FROM (
 SELECT t, search_id, gr, gc, arg_max({{'h': o, 'd': od, 'pr': npr, 'pc': npc, 'hp': ohp, 'dp': odp, 'near': y_near OR o - CASE WHEN od >= {NEAR_FROM} THEN {NEAR_M}::DOUBLE ELSE 0.0::DOUBLE END < h}}, {{'a': o, 'b': -npr, 'c': -npc}}) AS x FROM (
 SELECT *, CASE WHEN {take} THEN straight ELSE bend END AS o, CASE WHEN {take} THEN dp + leg ELSE y_d + step END AS od, CASE WHEN {take} THEN pr ELSE yr END AS npr, CASE WHEN {take} THEN pc ELSE yc END AS npc,
 CASE WHEN {take} THEN hp ELSE y_h END AS ohp, CASE WHEN {take} THEN dp ELSE y_d END AS odp FROM (
 SELECT *, coalesce(most > 0 AND floor((2 * vr + most) / (2 * most)::DOUBLE) = -dr AND floor((2 * vc + most) / (2 * most)::DOUBLE) = -dc, false) AS along, hp - leg * {GLIDE} AS straight, y_h - step * {GLIDE} AS bend FROM (
 SELECT *, greatest(abs(vr), abs(vc)) AS most, sqrt((vr * vr + vc * vc)::DOUBLE) * {CELL_M}::DOUBLE AS leg, sqrt((dr * dr + dc * dc)::DOUBLE) * {CELL_M}::DOUBLE AS step FROM (
 SELECT y.t + 1 AS t, y.search_id, y.gr AS yr, y.gc AS yc, y.gr + dr AS gr, y.gc + dc AS gc, dr, dc, y.pr - y.gr - dr AS vr, y.pc - y.gc - dc AS vc, y.h AS y_h, y.d AS y_d, y.near AS y_near, pr, pc, hp, dp, g.h
 FROM {name} y CROSS JOIN steps JOIN g ON g.gr = y.gr + dr AND g.gc = y.gc + dc ANTI JOIN {name}_0 z ON z.search_id = y.search_id AND z.gr = g.gr AND z.gc = g.gc WHERE y.t < {_ROUNDS})))) WHERE ({take}) OR ({bend}) GROUP BY ALL)
 UNION ALL SELECT t + 1, search_id, gr, gc, h, d, pr, pc, hp, dp, near FROM {name} WHERE d = 0 AND t < {_ROUNDS})),
 {name}_end AS MATERIALIZED (SELECT * FROM {name} WHERE t = {_ROUNDS})"""


_REACH = f"WITH RECURSIVE {_GROUND}, {_reach_sql('w', _STARTS)}"
SQL = {
    "glide_reach": f"""{_REACH} SELECT search_id, cast(gr AS int) AS gr, cast(gc AS int) AS gc, round(h, 4) AS height, round(d, 4) AS dist, cast(pr AS int) AS ref_gr, cast(pc AS int) AS ref_gc,
 CASE WHEN near THEN 'margin' ELSE 'clear' END AS state FROM w_end""",
    "glide_reach_bounds": f"""{_REACH} SELECT search_id, count(*) AS n, cast(min(gr) AS int) AS r_min, cast(max(gr) AS int) AS r_max, cast(min(gc) AS int) AS c_min, cast(max(gc) AS int) AS c_max,
 round(min(h), 4) AS lowest FROM w_end GROUP BY search_id""",
    "path_backtrace": f"{_WALK} SELECT target, depth, id FROM walk",
    "path_backtrace_sql": f"{_WALK} SELECT target, max(depth) AS legs, cast(sum(id) AS bigint) AS sum_id FROM walk GROUP BY target",
    "path_profile": f"""{_WALK}, a AS (SELECT target, depth, r, c, h, lead(r) OVER w AS r2, lead(c) OVER w AS c2, lead(h) OVER w AS h2 FROM walk JOIN t USING (id) WINDOW w AS (PARTITION BY target ORDER BY depth DESC)),
 b AS (SELECT *, cast(greatest(1, ceil(sqrt((r2 - r) * (r2 - r) + (c2 - c) * (c2 - c)))) AS int) AS n FROM a WHERE r2 IS NOT NULL), s AS (SELECT *, unnest(range(0, n)) AS i FROM b)
 SELECT target, depth, cast(i AS int) AS i, cast(round(r + (r2 - r) * (i / greatest(n - 1, 1)::DOUBLE)) AS int) AS r, cast(round(c + (c2 - c) * (i / greatest(n - 1, 1)::DOUBLE)) AS int) AS c,
 round(h + (h2 - h) * (i / greatest(n - 1, 1)::DOUBLE), 6) AS h FROM s""",
    "path_series": f"{_SERIES} SELECT target, depth, i, ground, round(dist, 6) AS dist, round(agl, 6) AS agl, round(floor, 6) AS floor FROM z",
    "path_margin": f"""{_SERIES} SELECT target, round(min(agl), 6) AS agl_min, round(max(agl), 6) AS agl_max,
 round(min(dist) FILTER (h - {MARGIN} + 14 < ground AND dist >= {START}), 6) AS first_in_margin FROM z GROUP BY target""",
    "profile_minmax": f"""{_WALK}, a AS (SELECT * FROM walk JOIN t USING (id)), g AS (SELECT target, min(h) AS h_min, max(h) AS h_max, max(depth) AS legs, max(r) FILTER (depth = 0) AS r0, max(c) FILTER (depth = 0) AS c0,
 max(dist) FILTER (depth = 0) AS d0, max(r) FILTER (depth = 1) AS r1, max(c) FILTER (depth = 1) AS c1 FROM a GROUP BY target)
 SELECT target, h_min, h_max, legs, ({_SECT!r})[1 + cast(floor(((degrees(atan2((c0 - c1)::DOUBLE, (r0 - r1)::DOUBLE)) + 382.5) % 360.0::DOUBLE) / 45) AS int)] AS sector, round(d0 / 1000.0::DOUBLE, 1) AS km FROM g""",
    "glide_reduced_stream": f"""WITH t AS (SELECT * FROM {I.TREE}), j AS (SELECT a.id, a.parent, a.dist, coalesce(b.dist, -1) AS pd FROM t a LEFT JOIN t b ON a.parent = b.id),
 o AS (SELECT *, row_number() OVER (ORDER BY pd, coalesce(parent, -1), dist, id) - 1 AS pos, lag(parent) OVER (PARTITION BY pd ORDER BY coalesce(parent, -1), dist, id) AS prev,
 row_number() OVER (PARTITION BY pd ORDER BY coalesce(parent, -1), dist, id) AS k FROM j)
 SELECT pos, cast(pos // {P.CHUNK_ROWS} AS int) AS chunk, id, CASE WHEN k > 1 AND prev IS NOT DISTINCT FROM parent THEN NULL ELSE parent END AS parent FROM o""",
    "delta_encode": f"""SELECT id, g, CASE WHEN k > 1 AND prev = ref THEN NULL ELSE ref END AS ref FROM (SELECT id, id // 1000 AS g, id // 40 AS ref, lag(id // 40) OVER (PARTITION BY id // 1000 ORDER BY id) AS prev,
 row_number() OVER (PARTITION BY id // 1000 ORDER BY id) AS k FROM {I.TREE})""",
    "delta_decode": f"SELECT id, id // 1000 AS g, id // 40 AS ref FROM {I.TREE}",
    "glide_cone_bounds": f"SELECT id, r - min(r) OVER () AS r, c - min(c) OVER () AS c FROM {I.TREE} WHERE r BETWEEN 20 AND 80 AND c BETWEEN 10 AND 70",
    "effective_glide_table": f"""WITH x AS (SELECT p_partkey, (p_partkey % 16) * {math.pi / 8}::DOUBLE AS a, (p_partkey % 50)::DOUBLE AS w FROM part),
 y AS (SELECT p_partkey, 38.0::DOUBLE * 38.0::DOUBLE - (sin(a) * w) * (sin(a) * w) AS lft, cos(a) * w AS along FROM x), z AS (SELECT p_partkey, lft, sqrt(greatest(lft, 0.0::DOUBLE)) + along AS v FROM y)
 SELECT p_partkey, round(CASE WHEN lft <= 0 OR v <= 0 THEN -1.0::DOUBLE ELSE 0.125::DOUBLE / (v / 38.0::DOUBLE) END, 6) AS glide FROM z""",
}
