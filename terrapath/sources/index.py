"""Tables clustered by an order, with a manifest of what each file spans: a query reads the files that can hold its answer.

Sites lie along a space-filling curve, names in their own order. The manifest has a row per file with the least and greatest value of the columns
that queries bound; it is small, and is filtered by Spark before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bbox_contains

#: Bits of each coordinate in the curve.
CURVE_BITS = 16


def _spread(x: Column) -> Column:
    """The 16 bits of a number with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve(lon: Column, lat: Column) -> Column:
    """A place's position along the Z-order curve over the globe."""
    cells = (1 << CURVE_BITS) - 1

    def cell(x: Column, low: float, span: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(cells), F.floor((x - low) / span * (cells + 1)))).cast("long")

    return _spread(cell(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(cell(lat, -90.0, 180.0)), 1))


def write(df: DataFrame, path: str, order: list[Column], spans: tuple[str, ...], files: int | None = None) -> None:
    """Writes ``df`` in ``order`` (of which there should be many values), and the manifest of the columns ``spans``.

    Rows are cut into ranges of the order, one file each; a value so frequent that it would fill several is one file.
    """
    named = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    by = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *named)
    ranged = keyed.repartitionByRange(files, *by) if files else keyed.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).drop(*by).write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    spanned = [f(c).alias(f"{n}_{c}") for c in spans for n, f in (("least", F.min), ("greatest", F.max))]
    rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *spanned).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def files(spark: SparkSession, path: str, bounds: dict[str, tuple]) -> list[str]:
    """The files that may hold rows within ``bounds`` (column -> least and greatest value; None leaves a side open)."""
    fits = F.lit(True)
    for column, (low, high) in bounds.items():
        fits &= F.lit(True) if low is None else F.col(f"greatest_{column}") >= F.lit(low)
        fits &= F.lit(True) if high is None else F.col(f"least_{column}") <= F.lit(high)
    return sorted(r["file"] for r in spark.read.parquet(f"{path}/manifest").filter(fits).select("file").collect())


def read(spark: SparkSession, path: str, bounds: dict[str, tuple]) -> DataFrame:
    """The rows of the files that may hold some within ``bounds``; filter them by the exact condition."""
    schema = spark.read.parquet(f"{path}/rows").schema
    found = files(spark, path, bounds)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def write_sites(sites: DataFrame, path: str, parts: int | None = None) -> None:
    """Sites (lon, lat and what they like) along the curve."""
    write(sites, path, [curve(F.col("lon"), F.col("lat"))], ("lon", "lat"), parts)


def sites_in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """The indexed sites in the closed box (south, west, north, east)."""
    s, w, n, e = box
    return read(spark, path, {"lon": (w, e), "lat": (s, n)}).filter(bbox_contains(s, w, n, e, "lat", "lon"))


def write_names(names: DataFrame, path: str, parts: int | None = None) -> None:
    """Names (name and what they like) in their order by bytes."""
    write(names, path, [F.col("name")], ("name",), parts)


def names_with_prefix(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The indexed names that begin with ``prefix``."""
    # The first string beyond all with the prefix: its last character that has a successor, raised.
    stem = prefix.rstrip("\U0010ffff")
    step = 0xE000 if stem and ord(stem[-1]) == 0xD7FF else ord(stem[-1]) + 1 if stem else 0
    beyond = stem[:-1] + chr(step) if stem else None
    return read(spark, path, {"name": (prefix or None, beyond)}).filter(F.col("name").startswith(prefix))
