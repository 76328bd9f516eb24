"""Relations that give the test tables geography: the same arithmetic in Spark and in SQL.

The tables have no coordinates, terrain or paths; these relations derive them from keys, so that every
operator has an input that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells along one side of a derived elevation tile.
SIDE = 32
#: Derived tiles of a part, so that what a task holds of them does not grow with the table.
PART_TILES = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, lon, lat, kind): one place per customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "5.0D + cast(c_custkey * 7919 % 10000 AS double) / 1000.0D AS lon",
        "43.0D + cast(c_custkey * 104729 % 6000 AS double) / 1000.0D AS lat", "c_mktsegment AS kind",
    )


SITES = """(SELECT c_custkey AS id, c_name AS name, 5.0E0 + cast(c_custkey * 7919 % 10000 AS double) / 1000.0E0 AS lon,
 43.0E0 + cast(c_custkey * 104729 % 6000 AS double) / 1000.0E0 AS lat, c_mktsegment AS kind FROM customer)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(box_id, south, west, north, east, grid): one stored window per supplier."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS box_id", *_WINDOW)


_WINDOW = [
    "43.0E0 + cast(s_suppkey * 37 % 50 AS double) / 10.0E0 AS south",
    "5.0E0 + cast(s_suppkey * 61 % 90 AS double) / 10.0E0 AS west",
    "43.0E0 + cast(s_suppkey * 37 % 50 AS double) / 10.0E0 + 0.25E0 + cast(s_suppkey % 3 AS double) / 4.0E0 AS north",
    "5.0E0 + cast(s_suppkey * 61 % 90 AS double) / 10.0E0 + 0.25E0 + cast(s_suppkey % 4 AS double) / 4.0E0 AS east",
    "cast(40 + s_suppkey % 5 * 10 AS double) AS grid",
]
WINDOWS = f"(SELECT s_suppkey AS box_id, {', '.join(_WINDOW)} FROM supplier)"


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, r, c, h): one square elevation tile per supplier, with voids, dealt by tile into parts of a bounded size.

    Tiles are made by a join with the numbers of their cells, and not by exploding an array: Spark takes an explode for as small as
    the table below it, and would send millions of cells to the driver and to all executors.
    """
    tiles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile"))
    parts = max(spark.sparkContext.defaultParallelism, -(-tiles.count() // PART_TILES))
    cells = tiles.repartition(parts, "tile").crossJoin(F.broadcast(spark.range(SIDE * SIDE).withColumnRenamed("id", "i")))
    return cells.selectExpr("tile", f"i div {SIDE} AS r0", f"i % {SIDE} AS c").selectExpr("tile", "cast(r0 AS int) AS r", "cast(c AS int) AS c", f"cast({_HEIGHT} AS int) AS h")


_HEIGHT = f"CASE WHEN (r0 * {SIDE} + c) % 53 = 7 THEN -32768 ELSE 400 + (r0 * 37 + c * 61 + (r0 * c) % 97 + tile * 13) % 900 END"
DEM = f"""(SELECT tile, cast(r0 AS int) AS r, cast(c AS int) AS c, cast({_HEIGHT} AS int) AS h FROM
 (SELECT s_suppkey AS tile, i // {SIDE} AS r0, i % {SIDE} AS c FROM supplier, (SELECT unnest(range({SIDE * SIDE})) AS i)))"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, category, name): a dotted category per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat('osm.', lower(replace(p_type, ' ', '_')), '.', lower(replace(p_brand, '#', '_'))) AS category", "p_name AS name"
    )


CATEGORIES = "(SELECT p_partkey, concat('osm.', lower(replace(p_type, ' ', '_')), '.', lower(replace(p_brand, '#', '_'))) AS category, p_name AS name FROM part)"


def category_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, name, categories): one or two categories per part; some are unique to a part."""
    rare = F.concat(F.lit("osm.rare.k"), F.col("p_partkey").cast("string"))
    return categories(spark, sf_dir).select("p_partkey", "name", F.when(F.col("p_partkey") % 17 == 0, F.array("category", rare)).otherwise(F.array("category")).alias("categories"))


CATEGORY_LISTS = f"""(SELECT p_partkey, name, CASE WHEN p_partkey % 17 = 0 THEN [category, 'osm.rare.k' || p_partkey] ELSE [category] END AS categories FROM {CATEGORIES})"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent, dist, r, c, h): a tree of path nodes, the root without parent."""
    return table(spark, sf_dir, "part").selectExpr(*_TREE)


_TREE = [
    "p_partkey AS id", "CASE WHEN p_partkey = 0 THEN NULL ELSE cast(floor(p_partkey / 2.0E0) AS bigint) END AS parent",
    "cast(p_partkey * 31 % 997 AS bigint) AS dist", "cast(p_partkey * 7 % 101 AS int) AS r", "cast(p_partkey * 11 % 89 AS int) AS c",
    "cast(3000 - p_partkey * 31 % 997 AS double) AS h",
]
TREE = f"(SELECT {', '.join(_TREE)} FROM part)"


def sql_round(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
