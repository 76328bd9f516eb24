"""Map tiles: zoom sets, coverage of windows, estimates and stored blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bbox_covers, bounds_around, subdomain, tile_x, tile_y

#: Zoom levels that are always stored, and the greatest one (fixed values).
ALWAYS, GREATEST_ZOOM = (13, 15), 18
#: Layers with the order of their paths' numbers and their mean bytes (fixed values).
LAYERS = (("topo", "zxy", 18_000), ("street", "zxy", 14_000), ("satellite", "zyx", 35_000))
LEAST_BLOB = 1_000
#: Requests for a height map that are tried, and the bounds of the margin that one may have (fixed values).
ATTEMPTS, LEAST_MARGIN_M, GREATEST_MARGIN_M = 4, 1_000.0, 300_000.0


def zoom_set(zoom) -> Column:
    """The zoom, two below and above it, and those that are always stored, within bounds."""
    z = F.array(*(zoom + d for d in (-2, 0, 2)), *map(F.lit, ALWAYS))
    return F.array_sort(F.array_distinct(F.filter(z, lambda x: x.between(0, GREATEST_ZOOM))))


def tile_range(windows: DataFrame, zooms: Column) -> DataFrame:
    """Adds zoom and the range of tiles (x0, x1, y0, y1) of each window; y grows to the south."""
    df = windows.withColumn("zoom", F.explode(zooms))
    return df.withColumns({"x0": tile_x("west", "zoom"), "x1": tile_x("east", "zoom"), "y0": tile_y("north", "zoom"), "y1": tile_y("south", "zoom")})


def coverage(windows: DataFrame, zooms: Column) -> DataFrame:
    """(box_id, zoom, x, y): every tile of every window."""
    ranges = tile_range(windows, zooms)
    return ranges.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1"))).select("box_id", "zoom", "x", "y")


def tiles(windows: DataFrame, zooms: Column) -> DataFrame:
    """(zoom, x, y): the tiles of all windows, once each; windows of equal ranges are listed once."""
    ranges = tile_range(windows, zooms).select("zoom", "x0", "x1", "y0", "y1").distinct()
    return ranges.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1"))).select("zoom", "x", "y").distinct()


def shapes(windows: DataFrame, zooms: Column) -> DataFrame:
    """``windows`` with ``shape``, the least box_id of those with the same edges and zooms: they want the same tiles."""
    same = ["south", "west", "north", "east", "zooms"]
    of = windows.withColumn("zooms", F.to_json(zooms))
    return of.join(of.groupBy(*same).agg(F.min("box_id").alias("shape")), same).drop("zooms")


def request_margins(windows: DataFrame) -> DataFrame:
    """Adds ``margins``: metres around a window's centre that are asked for, one attempt after the other.

    The first is half the larger side and some cells; each further one is a third larger and some cells more.
    """
    lat = (F.col("north") + F.col("south")) / 2
    up = (F.col("north") - F.col("south")) / 2 * 111_320
    right = (F.col("east") - F.col("west")) / 2 * 111_320 * F.greatest(F.cos(F.radians(lat)), F.lit(0.05))
    first = (F.ceil(F.greatest(up, right)) + F.greatest(F.lit(500.0), F.round(F.col("grid") * 8))).cast("double")
    more = F.aggregate(F.sequence(F.lit(2), F.lit(ATTEMPTS)), F.array(first), lambda acc, _: F.concat(acc, F.array(F.round(F.element_at(acc, -1) * 1.35 + F.greatest(F.lit(500.0), F.col("grid") * 6)))))
    return windows.withColumn("margins", more)


def covering_margin(windows: DataFrame) -> DataFrame:
    """(box_id, attempt, margin): the first of ``request_margins`` whose map covers the window; null if none does."""
    lat, lon = (F.col("north") + F.col("south")) / 2, (F.col("east") + F.col("west")) / 2

    def covers(m: Column) -> Column:
        held = F.greatest(F.lit(LEAST_MARGIN_M), F.least(F.lit(GREATEST_MARGIN_M), m))
        return bbox_covers(tuple(bounds_around(lat, lon, held)), ("south", "west", "north", "east"))

    tried = F.transform("margins", lambda m, i: F.struct((i + 1).alias("attempt"), m.alias("margin")))
    found = request_margins(windows).withColumn("m", F.get(F.filter(tried, lambda x: covers(x["margin"])), F.lit(0)))
    return found.select("box_id", "m.attempt", "m.margin")


def urls(tiles: DataFrame) -> DataFrame:
    """(layer, url) of each distinct tile in every layer."""
    layers = F.array(*(F.struct(F.lit(n).alias("layer"), F.lit(order).alias("order")) for n, order, _ in LAYERS))
    df = tiles.select("zoom", "x", "y").distinct().withColumn("l", F.explode(layers))
    z, x, y = (F.col(c).cast("string") for c in ("zoom", "x", "y"))
    path = F.when(F.col("l.order") == "zyx", F.concat_ws("/", z, y, x)).otherwise(F.concat_ws("/", z, x, y))
    return df.select(F.col("l.layer").alias("layer"), F.concat(F.lit("/"), subdomain("x", "y"), F.lit("/"), F.col("l.layer"), F.lit("/"), path, F.lit(".png")).alias("url"))


def estimate(windows: DataFrame, zooms: Column) -> DataFrame:
    """(box_id, n_tiles, n_bytes, and bytes per layer): computed from ranges, without listing tiles."""
    n = ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).cast("long")
    total = tile_range(windows, zooms).groupBy("box_id").agg(F.sum(n).alias("n_tiles"))
    per_layer = [(F.col("n_tiles") * b).alias(f"bytes_{name}") for name, _, b in LAYERS]
    return total.select("box_id", "n_tiles", (F.col("n_tiles") * sum(b for *_, b in LAYERS)).alias("n_bytes"), *per_layer)


#: Tiles of a layer and zoom whose bytes are averaged, about.
SAMPLED = 64
#: The modulus of the numbers by which tiles are drawn.
_DRAW = 10_007


def drawn(zoom, x, y) -> Column:
    """A tile's number in the draw, from 0 to 10,006: the same wherever and whenever the tile is seen."""
    return F.pmod(x.cast("long") * 7_919 + y.cast("long") * 104_729 + zoom.cast("long") * 31, F.lit(_DRAW))


def sampled_means(blobs: DataFrame, target: int = SAMPLED) -> DataFrame:
    """(layer, zoom, n_drawn, mean_bytes) of stored tiles (layer, zoom, x, y, size): the mean of a sample of each layer and zoom.

    A stratum of up to ``target`` sound tiles is averaged whole; of a larger one those whose number in the draw lies below its share, about as many. All of it is
    partial sums, whatever the size of a stratum.
    """
    sound = sound_blobs(blobs)
    shares = sound.groupBy("layer", "zoom").agg(F.ceil(F.lit(float(target * _DRAW)) / F.count("*")).alias("share"))
    picked = sound.join(F.broadcast(shares), ["layer", "zoom"]).filter(drawn(F.col("zoom"), F.col("x"), F.col("y")) < F.col("share"))  # a row per layer and zoom
    return picked.groupBy("layer", "zoom").agg(F.count("*").alias("n_drawn"), F.avg(F.col("size").cast("double")).alias("mean_bytes"))


def sampled_estimate(windows: DataFrame, zooms: Column, means: DataFrame) -> DataFrame:
    """(box_id, layer, n_tiles, n_bytes): bytes of each window's tiles, by the sampled mean of their zoom, else of the layer's nearest lower zoom, else by the fixed mean."""
    n = ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).cast("long")
    per_zoom = tile_range(windows, zooms).select("box_id", "zoom", n.alias("n"))
    layers = F.array(*(F.struct(F.lit(name).alias("layer"), F.lit(float(b)).alias("fixed")) for name, _, b in LAYERS))
    known = means.groupBy("layer").agg(F.map_from_entries(F.collect_list(F.struct("zoom", "mean_bytes"))).alias("known"))  # a zoom each
    wanted = per_zoom.withColumn("l", F.explode(layers)).select("box_id", "zoom", "n", "l.layer", "l.fixed").join(F.broadcast(known), "layer", "left")  # a row per layer
    lower = F.array_max(F.filter(F.map_keys("known"), lambda z: z <= F.col("zoom")))
    mean = F.coalesce(F.try_element_at("known", lower), F.col("fixed"))
    return wanted.groupBy("box_id", "layer").agg(F.sum("n").alias("n_tiles"), F.round(F.sum(F.col("n") * mean)).cast("long").alias("n_bytes"))


def sound_blobs(blobs: DataFrame, size: str = "size") -> DataFrame:
    """Blobs that are not broken: of at least 1,000 bytes."""
    return blobs.filter(F.col(size) >= LEAST_BLOB)


def first_cached(wanted: DataFrame, caches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Each wanted key with the blob of the first cache that holds a sound one, else null."""
    out, names = wanted, []
    for i, cache in enumerate(caches):
        names.append(f"blob{i}")
        out = out.join(sound_blobs(cache).select(*keys, F.col("blob").alias(names[-1])), keys, "left")
    return out.select(*keys, F.coalesce(*names).alias("blob"))


#: What names a tile of a provider's cache.
TILE_KEYS = ("provider", "zoom", "x", "y")


def _upstream() -> Column:
    """The path of a tile at its provider, whose numbers are in the order of its layer; zoom, column and row where the provider is none of them."""
    z, x, y = (F.col(c).cast("string") for c in ("zoom", "x", "y"))
    swapped = [name for name, order, _ in LAYERS if order == "zyx"]
    return F.concat_ws("/", F.col("provider"), F.when(F.col("provider").isin(swapped), F.concat_ws("/", z, y, x)).otherwise(F.concat_ws("/", z, x, y)))


def proxied(wanted: DataFrame, caches: list[DataFrame]) -> DataFrame:
    """(provider, zoom, x, y, blob, upstream): each wanted tile once, with the blob of its provider that the first cache holds whole.

    Where there is none, ``upstream`` is the path to fetch it from. Caches have (provider, zoom, x, y, size, blob), one row a tile; a tile of
    another provider never answers. A key that lacks a part is left out.
    """
    keys = list(TILE_KEYS)
    found = first_cached(wanted.select(*keys).dropna().distinct(), caches, keys)
    return found.withColumn("upstream", F.when(F.col("blob").isNull(), _upstream()))


def fill_cache(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """``cache`` with the sound ones of ``fetched`` (provider, zoom, x, y, size, blob), one row a tile: what the cache holds whole stays, and of several the largest, then the least, blob is kept."""
    cols = ["size", "blob"]
    both = cache.select(*TILE_KEYS, *cols, F.lit(1).alias("kept")).unionByName(fetched.select(*TILE_KEYS, *cols, F.lit(0).alias("kept")))
    best = sound_blobs(both).groupBy(*TILE_KEYS).agg(F.min_by(F.struct(*cols), F.struct(-F.col("kept"), -F.col("size"), "blob")).alias("b"))
    return best.select(*TILE_KEYS, *(F.col(f"b.{c}").alias(c) for c in cols))
