"""Readers: place dumps, site files and elevation tiles, as Spark sources with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

KNOWN_RECORDS = ("Place", "NominatimDumpFile", "CountryInfo")
_TILE_NAME = r"([NS])(\d{2})([EW])(\d{3})\.hgt$"


def locations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of places (name, center, additional_info); of a folder only its ``*.jsonl`` files."""
    return spark.read.schema(schemas.LOCATION).option("pathGlobFilter", "*.jsonl").json(path)


def augmented_places(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of places with their categories (name, center, categories, additional_info)."""
    return spark.read.schema(schemas.AUGMENTED).json(path)


def place_dump(spark: SparkSession, path: str) -> DataFrame:
    """The places of a dump of enveloped JSON lines, one row each; an unknown envelope is an error."""
    rows = spark.read.schema(schemas.PLACE_DUMP).json(path)
    known = F.when(F.col("type").isin(*KNOWN_RECORDS), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown record type: "), F.coalesce("type", F.lit("none")))))
    return rows.withColumn("type", known).filter("type = 'Place'").select(F.explode("content").alias("p")).select("p.*")


def sites_xml(spark: SparkSession, path: str) -> DataFrame:
    """Sites of an XML file: (name, type, lon, lat) of every location that isn't a towing site (type 3)."""
    rows = spark.read.format("xml").option("rowTag", "FlyingSite").schema(schemas.SITE_XML).load(path)
    one = rows.select(F.explode("Location").alias("l")).filter("l.LocationType <> '3'")
    at = F.split("l.Coordinates", ",")
    label = F.when(F.col("l.LocationType") == "1", "Start").otherwise("Landing")
    return one.select(F.trim("l.LocationName").alias("name"), label.alias("type"), F.trim(at[0]).cast("double").alias("lon"), F.trim(at[1]).cast("double").alias("lat"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lat, lon, content in zip(*(batch.column(c).to_pylist() for c in ("tile_lat", "tile_lon", "content")), strict=True):
            side = int(np.sqrt(len(content) // 2))
            if side * side * 2 != len(content):
                raise ValueError(f"tile {lat}, {lon} isn't square: {len(content)} bytes")
            h = np.frombuffer(content, ">i2").astype(np.int32)
            n, i = len(h), np.arange(len(h), dtype=np.int32)
            columns = [np.full(n, lat, np.int32), np.full(n, lon, np.int32), i // side, i % side, h]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["tile_lat", "tile_lon", "r", "c", "h"])


def elevation_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(tile_lat, tile_lon, r, c, h) of all tiles of a folder; row 0 is the north edge, voids are below -1000.

    A task decodes one file at a time, of a fixed size by format.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path)
    part = [F.regexp_extract("path", _TILE_NAME, i) for i in range(1, 5)]
    sign = [F.when(part[0] == "N", 1).otherwise(-1), F.when(part[2] == "E", 1).otherwise(-1)]
    keyed = files.select((part[1].cast("int") * sign[0]).alias("tile_lat"), (part[3].cast("int") * sign[1]).alias("tile_lon"), "content")
    return keyed.mapInArrow(_decoded, schemas.DEM)


def supported(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Points (lat, lon) on a tile that exists."""
    have = tiles.select("tile_lat", "tile_lon").distinct()
    keyed = points.withColumn("tile_lat", F.floor("lat").cast("int")).withColumn("tile_lon", F.floor("lon").cast("int"))
    return keyed.join(have, ["tile_lat", "tile_lon"], "left_semi").drop("tile_lat", "tile_lon")
