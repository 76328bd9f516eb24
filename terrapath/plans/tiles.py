"""Queries on map tiles, downloads and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flight as L
from ..operators import progress as P
from ..operators import tiles as T
from . import inputs as I


def tile_zooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.windows(spark, sf_dir).select("box_id", F.concat_ws(",", F.transform(T.zoom_set((F.col("box_id") % 19).cast("int")), lambda z: z.cast("string"))).alias("zooms"))


def _zooms():
    return T.zoom_set((F.col("box_id") % 5 + 4).cast("int"))


def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of all windows per zoom."""
    return T.coverage(I.windows(spark, sf_dir), _zooms()).groupBy("box_id", "zoom").agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("y").alias("y_max"))


def tile_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.estimate(I.windows(spark, sf_dir), _zooms()).withColumn("shown", L.format_bytes(F.col("n_bytes")))


def tile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of all tiles of the windows' own zooms, once each."""
    return T.urls(T.tiles(I.windows(spark, sf_dir), _zooms()))


def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted tiles that are not stored: stored are those with an even sum of numbers."""
    wanted = T.tiles(I.windows(spark, sf_dir), _zooms())
    stored = wanted.filter((F.col("x") + F.col("y")) % 2 == 0)
    return wanted.join(stored, ["zoom", "x", "y"], "left_anti")


def download_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending downloads of all windows, where the tiles of every third one are stored."""
    windows = T.shapes(I.windows(spark, sf_dir), _zooms())
    wanted = T.coverage(windows.filter("box_id = shape"), _zooms()).withColumnRenamed("box_id", "shape")
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    jobs = windows.select("box_id", "shape", F.lit("pending").alias("status"), (now - F.make_dt_interval(mins=F.col("box_id").cast("int"))).alias("updated_at"))
    stored = T.tiles(windows.filter("box_id % 3 = 0"), _zooms())
    return P.settle(jobs, wanted, stored, "shape", ["zoom", "x", "y"], now).select("box_id", "n_wanted", "n_stored", "status")


def fetch_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin that a height map for each window needs, windows being up to five degrees high."""
    return T.covering_margin(I.windows(spark, sf_dir).withColumn("north", F.col("north") + F.col("box_id") % 7))


def _blobs(spark: SparkSession, sf_dir: str, factor: int) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("tile"), (F.col("o_orderkey") * factor % 5000).alias("size"), F.concat(F.lit(f"b{factor}_"), F.col("o_orderkey").cast("string")).alias("blob"))


def small_blob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sound_blobs(_blobs(spark, sf_dir, 7)).select("tile", "size")


def tile_blob_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile from the first cache that holds it whole."""
    wanted = _blobs(spark, sf_dir, 7).select("tile")
    return T.first_cached(wanted, [_blobs(spark, sf_dir, 7), _blobs(spark, sf_dir, 11)], ["tile"])


def tile_bytes_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bytes per layer and in total."""
    layer = F.element_at(F.array(*(F.lit(n) for n, *_ in T.LAYERS)), (F.col("tile") % 3 + 1).cast("int"))
    return _blobs(spark, sf_dir, 7).withColumn("layer", layer).rollup("layer").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("shown", L.format_bytes(F.col("bytes")))


def _stored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored tile per part, in two layers and three zooms."""
    k = F.col("p_partkey")
    layer = F.when(k % 5 < 3, "topo").otherwise("street")
    return I.table(spark, sf_dir, "part").select(layer.alias("layer"), (9 + k % 3 * 2).cast("int").alias("zoom"), (k * 17 % 512).cast("int").alias("x"), (k * 29 % 509).cast("int").alias("y"), (k * 7919 % 40_000).alias("size"))


def tile_sampled_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean bytes of a sample of each layer and zoom of the stored tiles."""
    return T.sampled_means(_stored_tiles(spark, sf_dir)).withColumn("mean_bytes", F.round("mean_bytes", 6))


def tile_estimate_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each window's tiles by layer, from the sampled means."""
    return T.sampled_estimate(I.windows(spark, sf_dir), _zooms(), T.sampled_means(_stored_tiles(spark, sf_dir)))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events")


def job_status_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by user: the last event decides; those pending for long have failed."""
    last = P.latest(_events(spark, sf_dir), "user_id", ["ts", "event_type"])
    jobs = last.select("user_id", F.when(F.col("event_type") == "purchase", "complete").otherwise("pending").alias("status"), F.col("ts").alias("updated_at"))
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return P.reconcile(jobs.withColumn("updated_at", F.col("updated_at").cast("timestamp")), now).select("user_id", "status")


def progress_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.running_max(_events(spark, sf_dir).select("event_id", "ts", "user_id", F.round("value", 2).alias("value")), "user_id", "value").select("event_id", "user_id", "so_far")


def progress_5pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir).select("event_id", "ts", "user_id", (F.floor(F.col("value")) % 100).alias("pct"))
    return P.step_changes(df, "user_id", "pct").select("event_id", "user_id", "step")


def throttle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.throttle(_events(spark, sf_dir), "user_id", 600.0).select("event_id", "user_id")


def latest_query_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest(_events(spark, sf_dir), "user_id", ["event_id", "event_type"])


def downloads_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest events, the newest first."""
    return _events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id")


def upsert_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    changes = o.filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") + 3).alias("o_orderkey"), F.lit("X").alias("status"))
    return P.upsert(o, changes, "o_orderkey")


def antijoin_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return P.delete(o, I.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def json_props_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of a JSON column, by a declared schema."""
    df = _events(spark, sf_dir).select(F.from_json("props", "k long").getField("k").alias("k"))
    return df.groupBy((F.col("k") % 10).alias("digit")).agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per six hours (an extension: the same windows as the streaming query)."""
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    return _events(spark, sf_dir).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n")


def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


QUERIES = (
    tile_zooms, tile_coverage, tile_estimate, tile_urls, missing_tiles, small_blob_filter, tile_blob_coalesce, tile_bytes_by_layer, tile_sampled_means, tile_estimate_sampled, job_status_reconcile,
    progress_running_max, progress_5pct, throttle_events, latest_query_per_session, downloads_latest, upsert_jobs, antijoin_delete, usage_counters,
    json_props_scan, tumbling_counts, cube_counts, download_completeness, fetch_margins,
)

_W = I.WINDOWS


def _zoom_sql(base: str) -> str:
    return f"list_sort(list_distinct(list_filter([{base} - 2, {base}, {base} + 2, 13, 15], lambda z: z BETWEEN 0 AND 18)))"


def _x(lon: str) -> str:
    return f"cast(greatest(0, least(pow(2, zoom) - 1, floor(({lon} + 180) / 360 * pow(2.0::DOUBLE, zoom)))) AS int)"


def _y(lat: str) -> str:
    rad = f"radians(greatest(-85.05112878::DOUBLE, least(85.05112878::DOUBLE, {lat})))"
    return f"cast(greatest(0, least(pow(2, zoom) - 1, floor((1 - ln(tan({rad}) + 1 / cos({rad})) / 3.141592653589793::DOUBLE) / 2 * pow(2.0::DOUBLE, zoom)))) AS int)"


def _range(zooms: str) -> str:
    return f"(SELECT *, {_x('west')} AS x0, {_x('east')} AS x1, {_y('north')} AS y0, {_y('south')} AS y1 FROM (SELECT *, unnest({zooms}) AS zoom FROM {_W}))"


def _cover(zooms: str) -> str:
    return f"(SELECT box_id, zoom, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM {_range(zooms)}))"


def _bytes(n: str) -> str:
    return f"""CASE WHEN {n} < 1000 THEN {n} || ' B' WHEN {n} < 1000000 THEN cast(cast(round({n} / 1e3, 1) AS decimal(20,1)) AS varchar) || ' KB'
 WHEN {n} < 1000000000 THEN cast(cast(round({n} / 1e6, 1) AS decimal(20,1)) AS varchar) || ' MB' ELSE cast(cast(round({n} / 1e9, 1) AS decimal(20,1)) AS varchar) || ' GB' END"""


_ZOOM = _zoom_sql("cast(box_id % 5 + 4 AS int)")
_NAMES = ", ".join(f"'{n}'" for n, *_ in T.LAYERS)
_SUM = sum(b for *_, b in T.LAYERS)
_B7 = "(SELECT o_orderkey AS tile, o_orderkey * 7 % 5000 AS size, 'b7_' || o_orderkey AS blob FROM orders)"
_B11 = "(SELECT o_orderkey AS tile, o_orderkey * 11 % 5000 AS size, 'b11_' || o_orderkey AS blob FROM orders)"
_E = "PARTITION BY user_id ORDER BY ts, event_id"
_SAMPLED = f"""s AS (SELECT CASE WHEN p_partkey % 5 < 3 THEN 'topo' ELSE 'street' END AS layer, 9 + p_partkey % 3 * 2 AS zoom, p_partkey * 17 % 512 AS x, p_partkey * 29 % 509 AS y, p_partkey * 7919 % 40000 AS size FROM part),
 g AS (SELECT * FROM s WHERE size >= 1000), k AS (SELECT *, ceil({T.SAMPLED * 10_007}::DOUBLE / count(*) OVER (PARTITION BY layer, zoom)) AS share FROM g),
 means AS (SELECT layer, cast(zoom AS int) AS zoom, count(*) AS n_drawn, avg(size::DOUBLE) AS mean_bytes FROM k WHERE (x * 7919 + y * 104729 + zoom * 31) % 10007 < share GROUP BY ALL)"""
SQL = {
    "tile_sampled_means": f"WITH {_SAMPLED} SELECT layer, zoom, n_drawn, round(mean_bytes, 6) AS mean_bytes FROM means",
    "tile_estimate_sampled": f"""WITH {_SAMPLED}, w AS (SELECT box_id, zoom, (x1 - x0 + 1) * (y1 - y0 + 1) AS n FROM {_range(_ZOOM)}), l AS (SELECT unnest([{', '.join(f"{{'layer': '{n}', 'fixed': {b}::DOUBLE}}" for n, _, b in T.LAYERS)}]) AS l),
 x AS (SELECT box_id, l.layer AS layer, n, coalesce((SELECT arg_max(mean_bytes, m.zoom) FROM means m WHERE m.layer = l.layer AND m.zoom <= w.zoom), l.fixed) AS mean FROM w, l)
 SELECT box_id, layer, cast(sum(n) AS bigint) AS n_tiles, cast(round(sum(n * mean)) AS bigint) AS n_bytes FROM x GROUP BY box_id, layer""",
    "tile_zooms": f"SELECT box_id, array_to_string({_zoom_sql('cast(box_id % 19 AS int)')}, ',') AS zooms FROM {_W}",
    "tile_coverage": f"SELECT box_id, zoom, count(*) AS n, cast(min(x) AS int) AS x_min, cast(max(y) AS int) AS y_max FROM {_cover(_ZOOM)} GROUP BY 1, 2",
    "tile_estimate": f"""SELECT *, {_bytes('n_bytes')} AS shown FROM (SELECT box_id, n_tiles, n_tiles * {_SUM} AS n_bytes, {', '.join(f'n_tiles * {b} AS bytes_{n}' for n, _, b in T.LAYERS)}
 FROM (SELECT box_id, cast(sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS bigint) AS n_tiles FROM {_range(_ZOOM)} GROUP BY box_id))""",
    "tile_urls": f"""SELECT layer, '/' || ['a', 'b', 'c'][1 + (x + y) % 3] || '/' || layer || '/' || CASE WHEN layer = 'satellite' THEN zoom || '/' || y || '/' || x ELSE zoom || '/' || x || '/' || y END || '.png' AS url
 FROM (SELECT DISTINCT zoom, x, y FROM {_cover(_ZOOM)}), (SELECT unnest([{_NAMES}]) AS layer)""",
    "missing_tiles": f"SELECT DISTINCT zoom, cast(x AS int) AS x, cast(y AS int) AS y FROM {_cover(_ZOOM)} WHERE (x + y) % 2 <> 0",
    "small_blob_filter": f"SELECT tile, size FROM {_B7} WHERE size >= 1000",
    "tile_blob_coalesce": f"SELECT a.tile, CASE WHEN a.size >= 1000 THEN a.blob WHEN b.size >= 1000 THEN b.blob END AS blob FROM {_B7} a JOIN {_B11} b USING (tile)",
    "tile_bytes_by_layer": f"SELECT layer, n, bytes, {_bytes('bytes')} AS shown FROM (SELECT [{_NAMES}][1 + tile % 3] AS layer, count(*) AS n, cast(sum(size) AS bigint) AS bytes FROM {_B7} GROUP BY ROLLUP ([{_NAMES}][1 + tile % 3]))",
    "job_status_reconcile": f"""SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'complete' WHEN ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 MINUTE THEN 'failed' ELSE 'pending' END AS status
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
    "progress_running_max": f"SELECT event_id, user_id, max(round(value, 2)) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM events",
    "progress_5pct": f"""SELECT event_id, user_id, step FROM (SELECT *, lag(step) OVER ({_E}) AS before FROM (SELECT event_id, ts, user_id, cast(floor(max(cast(floor(value) AS bigint) % 100) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 5) AS int) AS step FROM events))
 WHERE before IS NULL OR step > before""",
    "throttle_events": f"SELECT event_id, user_id FROM (SELECT *, lag(ts) OVER ({_E}) AS b FROM events) WHERE b IS NULL OR epoch_us(ts) - epoch_us(b) >= 600000000",
    "latest_query_per_session": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "downloads_latest": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "upsert_jobs": """SELECT coalesce(c.k, o.o_orderkey) AS o_orderkey, CASE WHEN c.k IS NOT NULL THEN 'X' ELSE o.o_orderstatus END AS status FROM orders o
 FULL JOIN (SELECT o_orderkey + 3 AS k FROM orders WHERE o_orderkey % 3 = 0) c ON o.o_orderkey = c.k""",
    "antijoin_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "usage_counters": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "json_props_scan": "SELECT k % 10 AS digit, count(*) AS n, cast(sum(k) AS bigint) AS sum_k FROM (SELECT cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events) GROUP BY 1",
    "tumbling_counts": "SELECT (epoch_us(ts) // 1000000) // 21600 * 21600 AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "cube_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(cast(trunc(l_quantity) AS bigint)) AS bigint) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "download_completeness": f"""WITH w AS (SELECT DISTINCT box_id, zoom, x, y FROM {_cover(_ZOOM)}), s AS (SELECT DISTINCT zoom, x, y, 1 AS here FROM w WHERE box_id % 3 = 0),
 n AS (SELECT box_id, count(*) AS n_wanted, count(here) AS n_stored FROM w LEFT JOIN s USING (zoom, x, y) GROUP BY box_id)
 SELECT box_id, n_wanted, n_stored, CASE WHEN n_stored >= n_wanted THEN 'complete' WHEN box_id > 10 THEN 'failed' ELSE 'pending' END AS status FROM n""",
    "fetch_margins": f"""WITH w AS (SELECT box_id, south, west, east, grid, north + box_id % 7 AS north FROM {_W}), c AS (SELECT *, (north + south) / 2 AS lat, (east + west) / 2 AS lon, greatest(cos(radians((north + south) / 2)), 0.05::DOUBLE) AS k FROM w),
 m1 AS (SELECT *, ceil(greatest((north - south) / 2 * 111320, (east - west) / 2 * 111320 * k)) + greatest(500::DOUBLE, round(grid * 8)) AS a FROM c), m2 AS (SELECT *, round(a * 1.35::DOUBLE + greatest(500::DOUBLE, grid * 6)) AS b FROM m1),
 m3 AS (SELECT *, round(b * 1.35::DOUBLE + greatest(500::DOUBLE, grid * 6)) AS d FROM m2), m4 AS (SELECT *, round(d * 1.35::DOUBLE + greatest(500::DOUBLE, grid * 6)) AS e FROM m3),
 t AS (SELECT *, unnest([{{'attempt': 1, 'margin': a}}, {{'attempt': 2, 'margin': b}}, {{'attempt': 3, 'margin': d}}, {{'attempt': 4, 'margin': e}}]) AS x FROM m4),
 h AS (SELECT *, greatest(1000::DOUBLE, least(300000::DOUBLE, x.margin)) AS held FROM t),
 ok AS (SELECT box_id, min(x.attempt) AS attempt FROM h WHERE lat - held / 111320.0::DOUBLE <= south AND lat + held / 111320.0::DOUBLE >= north AND lon - held / (111320.0::DOUBLE * k) <= west AND lon + held / (111320.0::DOUBLE * k) >= east GROUP BY box_id)
 SELECT m4.box_id, attempt, CASE attempt WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN d WHEN 4 THEN e END AS margin FROM m4 LEFT JOIN ok USING (box_id)""",
}
