"""Sinks: JSON lines, cone tables, images and map documents, written by Spark tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def search_index(names: DataFrame, path: str) -> None:
    """Names by their first letters, so that a prefix search reads few files."""
    keyed = names.withColumn("head", F.coalesce(F.lower(F.substring("name", 1, 1)), F.lit("")))
    keyed.repartition("head").sortWithinPartitions("head", "name").write.mode("overwrite").parquet(path)


def cone_json(nodes: DataFrame) -> DataFrame:
    """(search_id, node): a JSON text per node; one file per partition instead of one document per search."""
    node = F.struct(F.array("r", "c").alias("index"), F.when(F.col("ref_r").isNotNull(), F.array("ref_r", "ref_c")).alias("reference"), "height", "distance", F.col("in_margin").alias("in_safety_margin"))
    return nodes.select("search_id", F.to_json(node, {"ignoreNullFields": "false"}).alias("node"))


def _png(pixels: np.ndarray) -> bytes:
    """A PNG of an array (rows, columns, 4) of bytes."""
    rows, cols, _ = pixels.shape
    raw = np.concatenate([np.zeros((rows, 1), np.uint8), pixels.reshape(rows, cols * 4)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", cols, rows, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def images(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """(tile, png) from (tile, x, y, red, green, and blue and alpha where there are any): one image per tile, a tile's pixels being bounded."""

    def draw(t: pa.Table) -> pa.Table:
        image = np.zeros((rows, cols, 4), np.uint8)
        at = t.column("y").to_numpy(), t.column("x").to_numpy()
        for i, name in enumerate(("red", "green", "blue", "alpha")):
            image[:, :, i][at] = t.column(name).to_numpy()
        return pa.table({"tile": t.column("tile").slice(0, 1), "png": pa.array([_png(image)], pa.binary())})

    rest = {n: F.col(n) if n in pixels.columns else F.lit(v) for n, v in (("blue", 0), ("alpha", 255))}
    plain = pixels.select(F.col("tile").cast("long").alias("tile"), "x", "y", "red", "green", *(c.cast("int").alias(n) for n, c in rest.items()))
    return plain.groupBy("tile").applyInArrow(draw, "tile long, png binary")


def kml(placemarks: DataFrame, path: str) -> None:
    """Placemarks, coloured, as KML documents: each file has head and tail, and one placemark a line."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def line(*texts: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

        yield line('<?xml version="1.0" encoding="UTF-8"?>', '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>')
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("kml")], names=["value"])
        yield line("</Document></kml>")

    placemarks.select("kml").mapInArrow(document, "value string").write.mode("overwrite").text(path)
