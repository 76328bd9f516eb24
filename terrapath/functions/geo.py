"""Geography as column expressions: distances, grids, boxes and map tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_MINUTE = 1852.0
MAX_MERCATOR_LAT = 85.05112878


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def _half_chord(lon1, lat1, lon2, lat2) -> Column:
    dlat, dlon = F.radians(_c(lat2) - _c(lat1)), F.radians(_c(lon2) - _c(lon1))
    return F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(_c(lat1))) * F.cos(F.radians(_c(lat2))) * F.pow(F.sin(dlon / 2), 2)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres."""
    a = _half_chord(lon1, lat1, lon2, lat2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_compat(lon1, lat1, lon2, lat2) -> Column:
    """The same order as ``haversine_m`` but not metres: the half chord enters unrooted."""
    a = _half_chord(lon1, lat1, lon2, lat2)
    return 2 * EARTH_RADIUS_M * F.atan2(a, F.sqrt(1 - a))


def arcsecond_m(lat) -> Column:
    """Metres of one arc second of longitude at a latitude."""
    return F.cos(F.radians(_c(lat))) * METRES_PER_MINUTE / 60


def metres_in_arcseconds(lat) -> Column:
    return 1 / arcsecond_m(lat)


def index_to_coordinate(i, n, low, high) -> Column:
    """The coordinate of grid line i of n lines from low to high, both included."""
    return _c(low) + (_c(high) - _c(low)) * _c(i) / F.greatest(_c(n) - 1, F.lit(1))


def cell_centre(i, n, low, high) -> Column:
    return _c(low) + (_c(i) + 0.5) / _c(n) * (_c(high) - _c(low))


def coordinate_to_index(x, n, low, high) -> Column:
    """The cell of n that holds coordinate x, clamped to the grid."""
    return F.greatest(F.lit(0), F.least(_c(n) - 1, F.floor((_c(x) - _c(low)) / (_c(high) - _c(low)) * _c(n)))).cast("int")


def angular_resolution(low, high, n) -> Column:
    """Degrees of one of n cells from low to high."""
    return (_c(high) - _c(low)) / _c(n)


def bbox_contains(south, west, north, east, lat, lon) -> Column:
    return _c(lat).between(_c(south), _c(north)) & _c(lon).between(_c(west), _c(east))


def bbox_covers(outer: tuple, inner: tuple) -> Column:
    """Whether box ``outer`` (south, west, north, east) holds box ``inner``."""
    o, i = [_c(x) for x in outer], [_c(x) for x in inner]
    return (o[0] <= i[0]) & (o[1] <= i[1]) & (o[2] >= i[2]) & (o[3] >= i[3])


def bbox_intersects(a: tuple, b: tuple) -> Column:
    p, q = [_c(x) for x in a], [_c(x) for x in b]
    return (p[0] <= q[2]) & (p[2] >= q[0]) & (p[1] <= q[3]) & (p[3] >= q[1])


def bbox_area(south, west, north, east) -> Column:
    return F.abs((_c(north) - _c(south)) * (_c(east) - _c(west)))


def tile_x(lon, zoom) -> Column:
    """Column of the slippy-map tile at a longitude, clamped to the map."""
    n = F.pow(F.lit(2.0), _c(zoom))
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((_c(lon) + 180) / 360 * n))).cast("int")


def tile_y(lat, zoom) -> Column:
    """Row of the slippy-map tile at a latitude, in Mercator's projection."""
    n = F.pow(F.lit(2.0), _c(zoom))
    rad = F.radians(F.greatest(F.lit(-MAX_MERCATOR_LAT), F.least(F.lit(MAX_MERCATOR_LAT), _c(lat))))
    y = (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / F.lit(3.141592653589793)) / 2 * n
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(y))).cast("int")


def subdomain(x, y) -> Column:
    return F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), ((_c(x) + _c(y)) % 3 + 1).cast("int"))


def hgt_name(lat, lon) -> Column:
    """File name of the elevation tile whose south-west corner is (lat, lon)."""
    return F.concat(
        F.when(_c(lat) >= 0, F.lit("N")).otherwise(F.lit("S")),
        F.lpad(F.abs(_c(lat)).cast("string"), 2, "0"),
        F.when(_c(lon) >= 0, F.lit("E")).otherwise(F.lit("W")),
        F.lpad(F.abs(_c(lon)).cast("string"), 3, "0"),
        F.lit(".hgt"),
    )


def search_margin_m(height, glide_number, low: float = 5_000, high: float = 120_000) -> Column:
    """How far a search may reach, within bounds."""
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), _c(height) * _c(glide_number)))).cast("long")


def bounds_around(lat, lon, margin_m) -> list[Column]:
    """South, west, north and east of a square of twice the margin around a point."""
    dlat = _c(margin_m) / 111_320.0
    dlon = _c(margin_m) / (111_320.0 * F.greatest(F.cos(F.radians(_c(lat))), F.lit(0.05)))
    return [_c(lat) - dlat, _c(lon) - dlon, _c(lat) + dlat, _c(lon) + dlon]
