"""Queries on JSON documents, views of a map, clamped progress and caches of providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import progress as P
from ..operators import requests as Q
from ..operators import tiles as T
from ..operators import views as V
from ..sources import documents as D
from . import inputs as I
from .paths import _GROUND, ACROSS, CELL_M
from .requests import _ANSWERS, _GRIDS, CORNER, DEGREES, _filled, _grids, _searched
from .tiles import _B7, _B11, _ZOOM, _blobs, _cover, _events, _zooms


def cone_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the cone document of every request."""
    asked, cells, store = _searched(spark, sf_dir)
    return D.cone_pieces(*Q.cones(asked, cells, I.SIDE, ACROSS, CELL_M, CORNER, DEGREES, store))


def height_map_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each request's height map, a row of cells a piece."""
    metas = _grids(spark, sf_dir)
    cells = _filled(spark, sf_dir)
    heights = Q.grid_heights(metas, cells, I.SIDE, ACROSS)
    found = Q.grid_metadata(metas, Q.middle_heights(metas, cells, I.SIDE, ACROSS))
    exact = {x: F.round(x, 6).cast(Q.DEGREE) for x in ("south", "west", "north", "east")}
    return D.height_map_pieces(found.withColumns(exact), heights)


def place_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of every window as a JSON array, forty at most."""
    return D.place_documents(I.windows(spark, sf_dir), I.sites(spark, sf_dir), 40)


def stats_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of two caches and counts of two kinds of events in one JSON object."""
    e = _events(spark, sf_dir)
    stores = {"png": _blobs(spark, sf_dir, 7), "webp": T.sound_blobs(_blobs(spark, sf_dir, 11))}
    return D.stats_document(stores, {"searches": e.filter("event_type = 'purchase'"), "index_accesses": e.filter("event_type = 'click'")})


_VIEW = (
    "43.0E0 + cast(user_id * 37 % 50 AS double) / 10.0E0 + cast(event_id % 5 AS double) / 20.0E0 AS south",
    "5.0E0 + cast(user_id * 61 % 90 AS double) / 10.0E0 + cast(event_id % 3 AS double) / 20.0E0 AS west",
    "0.25E0 + cast(event_id * 7 % 4 AS double) / 4.0E0 AS high",
)


def view_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's views, one per event, do: search for places, use those found before, or hide them."""
    at = _events(spark, sf_dir).selectExpr("cast(user_id AS string) AS session", "ts", "event_id AS box_id", "cast(9 + (event_id * 13 % 8 + 7) div 8 AS int) AS zoom", *_VIEW)
    return V.plan_views(at.withColumns({"north": F.col("south") + F.col("high"), "east": F.col("west") + F.col("high")}), I.sites(spark, sf_dir))


_PROGRESS = (
    "cast(20 + user_id % 60 AS bigint) AS total", "event_id % 9 AS records", "event_id * 31 % 4000 AS bytes", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE 5000 + user_id END AS bytes_total",
)


def download_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each user's download is done by each event, between what was done before and the total."""
    return P.clamped_progress(_events(spark, sf_dir).selectExpr("event_id", "ts", "user_id", *_PROGRESS), "user_id").select("event_id", "user_id", "total", "done")


def _provider_cache(spark: SparkSession, sf_dir: str, factor: int, zooms: int) -> DataFrame:
    """A cache row per order: its key decides the provider and one of few tiles."""
    k = F.col("tile")
    provider = F.element_at(F.array(*(F.lit(n) for n, *_ in T.LAYERS)), (k % 3 + 1).cast("int"))
    at = _blobs(spark, sf_dir, factor).select(provider.alias("provider"), (k % zooms + 2).cast("int").alias("zoom"), (k % 17).cast("int").alias("x"), (k % 13).cast("int").alias("y"), "size", "blob")
    return T.fill_cache(at.filter(F.lit(False)), at)


def provider_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile of the windows in every layer, from the layer's own caches, else the path to fetch it from."""
    wanted = T.tiles(I.windows(spark, sf_dir), _zooms()).select(F.explode(F.array(*(F.lit(n) for n, *_ in T.LAYERS))).alias("provider"), "zoom", "x", "y")
    return T.proxied(wanted, [_provider_cache(spark, sf_dir, 7, 3), _provider_cache(spark, sf_dir, 11, 7)])


def provider_cache_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache of the providers, filled up by what another one holds."""
    return T.fill_cache(_provider_cache(spark, sf_dir, 7, 3), _provider_cache(spark, sf_dir, 11, 7))


QUERIES = (cone_documents, height_map_documents, place_answers, stats_document, view_actions, download_progress, provider_tiles, provider_cache_filled)

_DEC = "DECIMAL(9,6)"


def _degree(k: int, cell: str) -> str:
    return f"cast(cast(round({CORNER[k]}::DOUBLE + ({cell}) * {DEGREES[k]}::DOUBLE, 6) AS {_DEC}) AS varchar)"


def _around(source: str, key: str, name: str, head: str, pieces: str) -> str:
    """Head, pieces and tail of documents: ``pieces`` has key, piece and text."""
    return f"""SELECT {key}, cast(-1 AS int) AS piece, {head} || ',"{name}":[' AS text FROM {source} UNION ALL SELECT {key}, {2**31 - 1}::INT, ']}}' FROM {source}
 UNION ALL SELECT {key}, cast(piece AS int), CASE WHEN piece = min(piece) OVER (PARTITION BY {key}) THEN '' ELSE ',' END || text FROM {pieces}"""


_CONE_HEAD = f"""'{{"cell_size":{CELL_M},"min_cell_size":{CELL_M},"angular_resolution":[' || {DEGREES[0]}::{_DEC} || ',' || {DEGREES[1]}::{_DEC} || '],"lat":[' || {_degree(0, 'r0')} || ',' || {_degree(0, 'r1 + 1')} ||
 '],"lon":[' || {_degree(1, 'c0')} || ',' || {_degree(1, 'c1 + 1')} || '],"start_ix":[' || gr - r0 || ',' || gc - c0 || '],"grid_shape":[' || r1 - r0 + 1 || ',' || c1 - c0 + 1 || '],"start_height":' || height"""
_MAP_HEAD = f"""'{{"cell_size":' || cell_size || ',"min_cell_size":{CELL_M},"lat":[' || {_degree(0, 'r0')} || ',' || {_degree(0, 'r0 + n_r')} || '],"lon":[' || {_degree(1, 'c0')} || ',' || {_degree(1, 'c0 + n_c')} ||
 '],"start_ix":[' || rows // 2 || ',' || cols // 2 || '],"grid_shape":[' || rows || ',' || cols || '],"start_height":' || coalesce(mid.h::VARCHAR, 'null')"""
_LAYER = "[" + ", ".join(f"'{n}'" for n, *_ in T.LAYERS) + "]"


def _cache_sql(source: str, zooms: int) -> str:
    return f"""(SELECT provider, zoom, x, y, best.size AS size, best.blob AS blob FROM (SELECT provider, zoom, x, y, arg_min({{'size': size, 'blob': blob}}, {{'a': -size, 'b': blob}}) AS best FROM (SELECT {_LAYER}[1 + tile % 3] AS provider,
 cast(tile % {zooms} + 2 AS int) AS zoom, cast(tile % 17 AS int) AS x, cast(tile % 13 AS int) AS y, size, blob FROM {source} WHERE size >= 1000) GROUP BY ALL))"""


SQL = {
    "cone_documents": f"""{_ANSWERS}, d AS (SELECT p.request_id, one.*, r0, r1, c0, c1 FROM p JOIN one ON p.k = one.search_id JOIN box USING (search_id)),
 n AS (SELECT request_id, w.gr - r0 AS r, w.gc - c0 AS c, trunc(w.h)::INT AS h, trunc(w.d)::INT AS dist, pr - r0 AS pr, pc - c0 AS pc, g.h AS low FROM d JOIN w_end w USING (search_id) JOIN g ON g.gr = w.gr AND g.gc = w.gc),
 t AS (SELECT request_id, r // {D.BLOCK} * 32768 + c // {D.BLOCK} AS piece, string_agg('{{"index":[' || r || ',' || c || '],"height":' || h || ',"distance":' || dist || ',"reference":' ||
 CASE WHEN pr IS NULL THEN 'null' ELSE '[' || pr || ',' || pc || ']' END || ',"agl":' || h - low || '}}', ',' ORDER BY r, c) AS text FROM n GROUP BY ALL)
 {_around('d', 'request_id', 'nodes', _CONE_HEAD, 't')}""",
    "height_map_documents": f"""WITH {_GROUND}, {_GRIDS}, l AS (SELECT request_id, rows, cols, unnest(range(0, rows)) AS r FROM m), k AS (SELECT request_id, r, unnest(range(0, cols)) AS c FROM l),
 t AS (SELECT request_id, r AS piece, '[' || string_agg(coalesce(h::VARCHAR, 'null'), ',' ORDER BY c) || ']' AS text FROM k LEFT JOIN x USING (request_id, r, c) GROUP BY ALL),
 d AS (SELECT m.*, mid.h FROM m LEFT JOIN x mid ON mid.request_id = m.request_id AND mid.r = rows // 2 AND mid.c = cols // 2)
 {_around('d', 'request_id', 'heights', _MAP_HEAD.replace('mid.h', 'd.h'), 't')}""",
    "place_answers": f"""WITH s AS (SELECT * FROM {I.SITES}), b AS (SELECT * FROM {I.WINDOWS}), j AS (SELECT box_id, id, name, kind, lon, lat, (west + east) / 2 AS mx, (south + north) / 2 AS my FROM b JOIN s ON lat BETWEEN south AND north AND lon BETWEEN west AND east),
 h AS (SELECT *, pow(sin(radians(lat - my) / 2), 2) + cos(radians(my)) * cos(radians(lat)) * pow(sin(radians(lon - mx) / 2), 2) AS a FROM j),
 o AS (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY 12742000.0::DOUBLE * atan2(sqrt(a), sqrt(1 - a)), id) AS k FROM h)
 SELECT box_id, '[' || coalesce(string_agg('{{"name":"' || name || '","center":[' || cast(round(lon, 3) AS DECIMAL(9,3)) || ',' || cast(round(lat, 3) AS DECIMAL(9,3)) || '],"additional_info":"' || kind || '"}}', ',' ORDER BY k) FILTER (k <= 40), '') || ']' AS places
 FROM b LEFT JOIN o USING (box_id) GROUP BY box_id""",
    "stats_document": f"""SELECT '{{"png_cache_size":' || (SELECT count(*) FROM {_B7}) || ',"png_bytes":' || (SELECT coalesce(sum(size), 0)::BIGINT FROM {_B7}) || ',"webp_cache_size":' || (SELECT count(*) FROM {_B11} WHERE size >= 1000) ||
 ',"webp_bytes":' || (SELECT coalesce(sum(size), 0)::BIGINT FROM {_B11} WHERE size >= 1000) || ',"num_searches":' || (SELECT count(*) FROM events WHERE event_type = 'purchase') || ',"num_index_accesses":' || (SELECT count(*) FROM events WHERE event_type = 'click') || '}}' AS stats""",
    "view_actions": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, south + high AS north, west + high AS east, row_number() OVER (PARTITION BY session ORDER BY ts, box_id) AS k FROM (SELECT user_id::VARCHAR AS session, ts, event_id AS box_id,
 9 + (event_id * 13 % 8 + 7) // 8 AS zoom, {', '.join(_VIEW)} FROM events)), c AS MATERIALIZED (SELECT box_id, count(s.id) AS n FROM e LEFT JOIN {I.SITES} s ON s.lat BETWEEN south AND north AND s.lon BETWEEN west AND east GROUP BY box_id),
 v AS MATERIALIZED (SELECT * FROM e JOIN c USING (box_id)),
 f(session, k, box_id, action, from_box, shown) AS (SELECT session, 1, box_id, CASE WHEN zoom < 10 THEN 'hide' ELSE 'search' END, CASE WHEN zoom >= 10 THEN box_id END, CASE WHEN zoom < 10 THEN 0 ELSE n END FROM v WHERE k = 1
 UNION ALL SELECT x.session, x.k, x.box_id, CASE WHEN x.zoom < 10 THEN 'hide' WHEN fits THEN 'reuse' ELSE 'search' END, CASE WHEN x.zoom < 10 OR fits THEN x.was ELSE x.box_id END, CASE WHEN x.zoom < 10 THEN 0 WHEN fits THEN x.shown ELSE x.n END
 FROM (SELECT v.session, v.k, v.box_id, v.zoom, v.n, f.from_box AS was, f.shown, coalesce(l.south <= v.south AND l.west <= v.west AND l.north >= v.north AND l.east >= v.east AND f.shown > 0 AND f.shown < 100, false) AS fits
 FROM f JOIN v ON v.session = f.session AND v.k = f.k + 1 LEFT JOIN v l ON l.box_id = f.from_box) x)
 SELECT session, box_id, action, CASE WHEN action <> 'hide' THEN from_box END AS from_box FROM f""",
    "download_progress": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT event_id, ts, user_id, {', '.join(_PROGRESS)} FROM events)),
 x AS MATERIALIZED (SELECT *, floor(total * bytes / bytes_total::DOUBLE + 0.5::DOUBLE) AS share FROM e), f(user_id, k, event_id, total, done) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM x WHERE k = 1
 UNION ALL SELECT x.user_id, x.k, x.event_id, x.total, cast(greatest(0, least(x.total, greatest(x.records, CASE WHEN x.bytes_total > 0 THEN x.share ELSE f.done + 1 END, f.done))) AS bigint) FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
 SELECT event_id, user_id, total, done FROM f WHERE k > 0""",
    "provider_tiles": f"""WITH w AS (SELECT DISTINCT provider, zoom, cast(x AS int) AS x, cast(y AS int) AS y FROM {_cover(_ZOOM)}, (SELECT unnest({_LAYER}) AS provider)), j AS (SELECT w.*, coalesce(a.blob, b.blob) AS blob
 FROM w LEFT JOIN {_cache_sql(_B7, 3)} a USING (provider, zoom, x, y) LEFT JOIN {_cache_sql(_B11, 7)} b USING (provider, zoom, x, y))
 SELECT *, CASE WHEN blob IS NULL THEN provider || '/' || zoom || '/' || CASE provider WHEN 'satellite' THEN y || '/' || x ELSE x || '/' || y END END AS upstream FROM j""",
    "provider_cache_filled": f"""SELECT provider, zoom, x, y, coalesce(a.size, b.size) AS size, coalesce(a.blob, b.blob) AS blob FROM {_cache_sql(_B7, 3)} a FULL JOIN {_cache_sql(_B11, 7)} b USING (provider, zoom, x, y)""",
}
