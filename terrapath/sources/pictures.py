"""Height images read back: PNG files of which red and green are the high and low byte of a height."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels by the format's colour type, those of eight bits a channel without a palette (fixed values).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of a PNG file is broken")
        yield kind, body
        at += 12 + size


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A line of pixels (columns, channels) as it was before its filter, given the line above."""
    if kind == NONE:
        return line
    if kind == SUB:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == UP:
        return line + above
    if kind not in (AVERAGE, PAETH):
        raise ValueError(f"unknown line filter {kind}")
    out = np.zeros_like(line)
    for ch in range(line.shape[1]):  # each pixel needs the one before it
        left = corner = 0
        done = []
        for x, up in zip(line[:, ch].tolist(), above[:, ch].tolist(), strict=True):
            if kind == AVERAGE:
                near = (left + up) // 2
            else:
                guess = left + up - corner
                a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
                near = left if a <= b and a <= c else up if b <= c else corner
                corner = up
            left = (x + near) & 255
            done.append(left)
        out[:, ch] = done
    return out


def pixels(data: bytes) -> np.ndarray:
    """The pixels (rows, columns, channels) of a PNG file of eight bits a channel, not interlaced; others are an error."""
    head, packed = None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError(f"unsupported PNG file: {head}")
    cols, rows, channels = head[0], head[1], CHANNELS[head[3]]
    try:
        lines = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError("the pixels of a PNG file are broken") from e
    if len(lines) != rows * (1 + cols * channels):
        raise ValueError(f"a PNG file of {rows} by {cols} has {len(lines)} bytes of pixels")
    raw = np.frombuffer(lines, np.uint8).reshape(rows, 1 + cols * channels)
    out, above = np.zeros((rows, cols, channels), np.uint8), np.zeros((cols, channels), np.uint8)
    for r in range(rows):
        above = out[r] = _unfiltered(int(raw[r, 0]), raw[r, 1:].reshape(cols, channels), above)
    return out


def decoded(images: DataFrame) -> DataFrame:
    """(tile, r, c, h) of each image (tile, png), row 0 at the bottom. A task decodes one image at a time; a broken one is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, png in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = pixels(png)
                if p.shape[2] < 3:
                    raise ValueError(f"image {tile} has no red and green")
                h = (p[::-1, :, 0].astype(np.int32) << 8 | p[::-1, :, 1]).ravel()
                r, c = (x.ravel().astype(np.int32) for x in np.indices(p.shape[:2]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), tile, np.int64)), *map(pa.array, (r, c, h))], names=["tile", "r", "c", "h"])

    return images.select(F.col("tile").cast("long"), "png").mapInArrow(run, "tile long, r int, c int, h int")


def height_images(spark: SparkSession, path: str) -> DataFrame:
    """The heights of all files ``<tile>.png`` of a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return decoded(found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("tile"), F.col("content").alias("png")))
