"""Glide arithmetic and colours as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

#: Colour stops of the height palette, and the darker one of the safety margin (fixed values).
STEPS = (0.0, 0.5, 1.0)
COLOURS = ((255, 0, 0), (180, 190, 0), (0, 150, 255))
MARGIN_COLOURS = ((153, 0, 0), (108, 114, 0), (0, 90, 153))


def effective_glide(glide, trim, wind, angle) -> Column:
    """Height lost per distance under wind; infinite where the wind wins.

    ``angle`` is that between flight and wind: the cross part is flown off, the rest helps or hinders.
    """
    cross, along = F.sin(_c(angle)) * _c(wind), F.cos(_c(angle)) * _c(wind)
    left = _c(trim) * _c(trim) - cross * cross
    speed = F.sqrt(F.greatest(left, F.lit(0.0))) + along
    return F.when((left <= 0) | (speed <= 0), F.lit(math.inf)).otherwise(_c(glide) / (speed / _c(trim)))


def wind_angle(direction, dr, dc) -> Column:
    """The angle for a leg of (dr, dc) cells from the new cell to its reference."""
    return -_c(direction) + math.pi / 2 - F.atan2(_c(dr).cast("double"), _c(dc).cast("double"))


def margin_at(distance, margin, start_distance) -> Column:
    """The safety margin that holds at a distance from the start."""
    return F.when(_c(distance) < _c(start_distance), F.lit(0.0)).otherwise(_c(margin).cast("double"))


def grid_distance(r1, c1, r2, c2) -> Column:
    return F.sqrt(F.pow(_c(r1) - _c(r2), 2) + F.pow(_c(c1) - _c(c2), 2))


def lerp(a, b, t) -> Column:
    return _c(a) + (_c(b) - _c(a)) * _c(t)


def colour_channel(s, channel: int, colours=COLOURS) -> Column:
    """One channel of a palette at s; the last colour outside [0, 1), null included."""
    out = F.lit(float(colours[-1][channel]))
    for i in range(len(STEPS) - 2, -1, -1):
        t = (_c(s) - STEPS[i]) / (STEPS[i + 1] - STEPS[i])
        inside = (_c(s) >= STEPS[i]) & (_c(s) < STEPS[i + 1])
        out = F.when(inside, lerp(float(colours[i][channel]), float(colours[i + 1][channel]), t)).otherwise(out)
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(out))).cast("int")


def compass_sector(dr, dc) -> Column:
    """One of eight compass names for a leg; rows grow to the north, columns to the east."""
    turn = F.pmod(F.degrees(F.atan2(_c(dc).cast("double"), _c(dr).cast("double"))) + 22.5, F.lit(360.0))
    names = F.array(*(F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(names, (F.floor(turn / 45) + 1).cast("int"))


def format_bytes(n) -> Column:
    """Bytes with a unit: whole below 1,000, else one decimal."""
    n = _c(n)
    return (
        F.when(n < 1_000, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1_000_000, F.concat(F.round(n / 1e3, 1).cast("decimal(20,1)").cast("string"), F.lit(" KB")))
        .when(n < 1_000_000_000, F.concat(F.round(n / 1e6, 1).cast("decimal(20,1)").cast("string"), F.lit(" MB")))
        .otherwise(F.concat(F.round(n / 1e9, 1).cast("decimal(20,1)").cast("string"), F.lit(" GB")))
    )


def register_functions(spark) -> None:
    """SQL names for the numeric helpers, as temporary SQL functions (inlined by the optimizer)."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_m(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE RETURN "
        "2 * 6371000.0D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION effective_glide(glide DOUBLE, trim DOUBLE, wind DOUBLE, angle DOUBLE) RETURNS DOUBLE RETURN "
        "CASE WHEN trim * trim - pow(sin(angle) * wind, 2) <= 0 OR sqrt(greatest(trim * trim - pow(sin(angle) * wind, 2), 0D)) + cos(angle) * wind <= 0 THEN double('Infinity') "
        "ELSE glide / ((sqrt(trim * trim - pow(sin(angle) * wind, 2)) + cos(angle) * wind) / trim) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tile_y(lat DOUBLE, z INT) RETURNS INT RETURN cast(greatest(0, least(pow(2, z) - 1, floor("
        "(1 - ln(tan(radians(greatest(-85.05112878D, least(85.05112878D, lat)))) + 1 / cos(radians(greatest(-85.05112878D, least(85.05112878D, lat))))) / pi()) / 2 * pow(2, z)))) AS INT)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lerp(a DOUBLE, b DOUBLE, t DOUBLE) RETURNS DOUBLE RETURN a + (b - a) * t")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tile_x(lon DOUBLE, z INT) RETURNS INT RETURN cast(greatest(0, least(pow(2, z) - 1, floor((lon + 180) / 360 * pow(2, z)))) AS INT)")
