"""Every named query of the library, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, paths, places, raster, requests, spatial, stores, text, tiles

_PARTS = (places, spatial, raster, paths, requests, stores, text, tiles, documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for part in _PARTS for f in part.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
