"""Queries on stores and streams: clustered indexes that are read back, downloads from batches of events, deltas with state, SQL table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..shared import new_path, written
from ..sources import index
from ..streaming import deltas, downloads
from . import inputs as I
from . import text

BOX = (44.25, 6.5, 46.0, 9.75)
PREFIX, SOUGHT = "Customer#0000001", "Custmer#000000012"
#: The time at which downloads are looked at.
NOW = "2024-01-15 00:00:00"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def indexed_box_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of a box, out of an index along a space-filling curve."""
    path = new_path(spark, "sites-index")
    index.write_sites(I.sites(spark, sf_dir), path)
    return index.sites_in_box(spark, path, BOX).select("id", "name", "lon", "lat")


def indexed_prefix_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a prefix, out of an index in their order."""
    path = new_path(spark, "names-index")
    index.write_names(I.sites(spark, sf_dir).select("id", "name"), path)
    return index.names_with_prefix(spark, path, PREFIX)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as one of a download's: a group of four users is a download."""
    k, u = F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.array(*map(F.lit, ("request", "height_map", "sites", "error", "retry", "tile", "tile", "tile", "tile", "tile"))), (k % 10 + 1).cast("int"))
    e = I.table(spark, sf_dir, "events").withColumn("kind", kind)

    def when(name: str, value):  # noqa: ANN001, ANN202
        return F.when(F.col("kind") == name, value)

    urls = F.transform(F.sequence(F.lit(0), (u % 3).cast("int")), lambda i: F.concat(F.lit("t"), i.cast("string")))
    return e.select(
        k.alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr("user_id div 4").alias("download_id"), "kind", when("request", urls).alias("urls"), F.lit(50.0).alias("grid"),
        when("tile", F.concat(F.lit("t"), (k % 4).cast("string"))).alias("url"), when("tile", k * 7919 % 20_000).alias("bytes"), when("sites", k % 9).alias("n"), when("error", F.concat(F.lit("e"), k.cast("string"))).alias("error"),
    )


def download_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads as they stand after three batches of events, one of which comes twice."""
    store, events = downloads.Store(spark, new_path(spark, "downloads")), _events(spark, sf_dir)
    for number, part in enumerate((0, 1, 1, 2)):
        store.add(events.filter(F.expr("event_id div 7") % 3 == part), number - (number > 1))
    store.compact()
    return downloads.statuses(store.tables(), F.lit(NOW).cast("timestamp"))


def delta_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of 97 searches, as a stream with state sends them; the stream comes in two batches."""
    source, out, checkpoint = (new_path(spark, f"deltas-{x}") for x in ("in", "out", "checkpoint"))
    rows = I.tree(spark, sf_dir).select((F.col("id") % 97).alias("search_id"), F.col("id").alias("pos"), F.expr("id div 400").alias("ref"))
    middle = (rows.agg(F.max("pos")).first()[0] or 0) // 2
    before = spark.conf.get(_NO_DATA)
    spark.conf.set(_NO_DATA, "false")  # the stream ends with its data, not with its timers
    try:
        for part in (F.col("pos") <= middle, F.col("pos") > middle):
            rows.filter(part).write.mode("append").parquet(source)
            stream = deltas.delta_stream(spark.readStream.schema(deltas.ROWS).parquet(source))
            with deltas.state_on_disk(spark):
                stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_NO_DATA, before)
    return spark.read.schema(deltas.OUT).parquet(out)


def fuzzy_search_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of the SQL table function to one misspelt name."""
    tables.register_fuzzy_search(spark, text._names(spark, sf_dir).unionByName(I.sites(spark, sf_dir).select("name")))
    return written(spark.sql(f"SELECT * FROM fuzzy_search('{SOUGHT}')"), "answers")


QUERIES = (indexed_box_sites, indexed_prefix_names, download_jobs, delta_stream, fuzzy_search_sql)

_KINDS = "['request', 'height_map', 'sites', 'error', 'retry', 'tile', 'tile', 'tile', 'tile', 'tile']"
SQL = {
    "indexed_box_sites": f"SELECT id, name, lon, lat FROM {I.SITES} WHERE lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]}",
    "indexed_prefix_names": f"SELECT id, name FROM {I.SITES} WHERE starts_with(name, '{PREFIX}')",
    "download_jobs": f"""WITH e AS (SELECT *, user_id // 4 AS d, {_KINDS}[1 + event_id % 10] AS kind, event_id * 7919 % 20000 AS size FROM events),
 w AS (SELECT DISTINCT d, 't' || unnest(range(0, user_id % 3 + 1)) AS url FROM e WHERE kind = 'request'),
 t AS (SELECT d, 't' || event_id % 4 AS url, arg_max(size, {{'a': ts, 'b': event_id}}) AS bytes FROM e WHERE kind = 'tile' AND size >= 1000 GROUP BY ALL),
 c AS (SELECT d, count(*) AS n_wanted, count(bytes) AS n_stored, coalesce(sum(bytes), 0)::BIGINT AS n_bytes FROM w LEFT JOIN t USING (d, url) GROUP BY d),
 r AS (SELECT d, max({{'a': ts, 'b': event_id}}) FILTER (kind IN ('request', 'retry')) AS started, max({{'a': ts, 'b': event_id}}) FILTER (kind = 'error') AS failed, count(*) FILTER (kind IN ('request', 'retry')) AS attempts,
 bool_or(kind = 'request') AND bool_or(kind = 'height_map') AND bool_or(kind = 'sites') AS parts, coalesce(arg_max(event_id % 9, {{'a': ts, 'b': event_id}}) FILTER (kind = 'sites'), 0) AS n_sites, max(ts) AS updated FROM e GROUP BY d),
 x AS (SELECT *, coalesce(failed > started, failed IS NOT NULL) AS bad, parts AND coalesce(n_stored, 0) >= coalesce(n_wanted, 0) AS whole, updated < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AS stale FROM r LEFT JOIN c USING (d))
 SELECT d AS download_id, CASE WHEN bad THEN 'failed' WHEN whole THEN 'complete' WHEN stale THEN 'failed' ELSE 'pending' END AS status, attempts, coalesce(n_wanted, 0) AS n_wanted, coalesce(n_stored, 0) AS n_stored, coalesce(n_bytes, 0) AS n_bytes, n_sites,
 CASE WHEN bad THEN 'e' || failed.b WHEN NOT whole AND stale THEN 'stalled' END AS last_error FROM x""",
    "delta_stream": f"""SELECT search_id, pos, CASE WHEN k > 1 AND prev = ref THEN NULL ELSE ref END AS ref, k = 1 AS first FROM (SELECT id % 97 AS search_id, id AS pos, id // 400 AS ref,
 lag(id // 400) OVER (PARTITION BY id % 97 ORDER BY id) AS prev, row_number() OVER (PARTITION BY id % 97 ORDER BY id) AS k FROM {I.TREE})""",
    "fuzzy_search_sql": f"""SELECT name, cast(distance AS int) AS distance, cast(row_number() OVER (ORDER BY distance, length(name), name) - 1 AS int) AS rank FROM (SELECT name, list_min(list_transform(range(0, length(name) + 1), lambda i: levenshtein('{SOUGHT}', name[1:i]))) AS distance
 FROM (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer)) WHERE distance <= {len(SOUGHT) // 4} ORDER BY distance, length(name), name LIMIT 10""",
}
