"""The place-cleaning job: from a dump of places to the names that a search offers.

Two steps, each a chain of filters and joins: ``augmented`` picks name, centre and label of every useful place,
``search_places`` keeps what is worth searching for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from ..sources import readers, writers
from . import places as P

# Categories that are left out (``x.*``: all that begin with x), also where a place has no geometry.
IGNORED = (
    "osm.building.yes", "osm.place.house", "osm.building.house", "osm.building.apartments", "osm.building.residential", "osm.highway.path",
    "osm.amenity.doctors", "osm.information.board", "osm.shop.*", "osm.office.company", "osm.boundary.*", "osm.aerialway.*", "osm.lock.*",
    "osm.highway.*", "osm.building.terrace",
)
IGNORED_WITHOUT_GEOMETRY = (
    "osm.waterway.weir", "osm.water.reservoir", "osm.landuse.*", "osm.highway.*", "osm.leisure.park", "osm.waterway.boatyard",
    "osm.natural.grassland", "osm.place.square", "osm.place.locality", "osm.place.house", "osm.building.*", "osm.amenity.*",
)
COUNTRIES = {
    "fr": "France", "mc": "Monacco", "at": "Austria", "de": "Germany", "lu": "Luxemburg", "ch": "Switzerland", "li": "Liechtenstein", "it": "Italy",
    "si": "Slovenia",
}
# Fixed values of the second step.
DROPPED = ("osm.historic.boundary_stone", "osm.waterway.milestone", "osm.railway.border", "osm.information.map", "osm.information.guidepost")
DROPPED_LEVELS = ("osm.boundary", "osm.amenity", "osm.leisure", "osm.tourism", "osm.landuse", "osm.office", "osm.craft")
KEPT = {
    "osm.building": ("cabin", "service", "public", "hut", "dormitory", "roof", "shed", "ruins"),
    "osm.place": ("locality", "hamlet", "village", "suburb", "neighbourhood", "town", "quarter", "municipality", "region", "county", "island", "city"),
    "osm.historic": ("castle", "building", "ruins", "church", "monument", "tower", "house", "razed:mineshaft"),
    "osm.waterway": ("stream", "canal", "weir", "river", "waterfall", "dam", "rapids"),
}
MORE_THAN, FEWER_NAMES = 10, 5


def geometry_centre(geometry: Column, centroid: Column) -> Column:
    """The centroid, else a centre by the geometry's type: a point, the middle of a line, or the first ring's points over the rings."""
    kind = geometry["type"]

    def coordinates(ddl: str) -> Column:
        return F.try_variant_get(geometry["coordinates"], "$", ddl)

    point, line, rings, polygons = (coordinates(f"{'array<' * n}double{'>' * n}") for n in (1, 2, 3, 4))
    n, half = F.size(line), F.floor(F.size(line) / 2).cast("int")
    middle = F.when(n % 2 == 1, F.get(line, half)).otherwise(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: (F.get(F.get(line, half - 1), i) + F.get(F.get(line, half), i)) / 2))
    known = (
        F.when(kind == "Point", point)
        .when(kind == "LineString", middle)
        .when(kind.isin("Polygon", "MultiLineString"), P.centre(F.get(rings, F.lit(0)), F.size(rings)))
        .when(kind == "MultiPolygon", P.centre(F.flatten(F.get(polygons, F.lit(0))), F.size(polygons)))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported geometry: "), F.coalesce(kind, F.lit("none")))))
    )
    sound = F.when(F.size(centroid) == 2, centroid).otherwise(F.raise_error(F.lit("a centroid has two numbers")))
    return F.when(centroid.isNotNull(), sound).otherwise(known)


def augmented(places: DataFrame, region: str) -> DataFrame:
    """(name, center, categories, additional_info) of the places of a dump that have a name and no ignored or unique category.

    ``places`` has the columns of ``readers.place_dump``. A named place without geometry is an error unless its category
    excuses it. A category counts as unique among all places that aren't ignored, named or not.
    """
    categories = F.coalesce("categories", F.array().cast("array<string>"))
    kept = places.withColumn("categories", categories).filter(~P.matches_any(F.col("categories"), IGNORED))
    once = kept.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n")).filter("n = 1").select("category")
    bare = F.col("geometry").isNull()
    named = kept.filter(F.col("name").isNotNull() & ~(bare & P.matches_any(F.col("categories"), IGNORED_WITHOUT_GEOMETRY)))
    centre = F.when(bare, F.raise_error(F.lit("a named place has no geometry"))).otherwise(geometry_centre(F.col("geometry"), F.col("centroid")))
    label = P.context_label(F.coalesce("address", F.create_map().cast("map<string,string>")), F.col("country_code"), COUNTRIES, F.lit(region))
    rows = named.select(P.best_name(F.col("name")).alias("name"), centre.cast("array<double>").alias("center"), "categories", label.alias("additional_info"), F.monotonically_increasing_id().alias("__row"))
    rows = written(rows, "places")  # both sides of the join read the same numbers
    hit = rows.select("__row", F.explode("categories").alias("category")).join(once, "category", "left_semi").select("__row").distinct()
    return rows.join(hit, "__row", "left_anti").drop("__row")


def search_places(rows: DataFrame, more_than: int = MORE_THAN, fewer_names: int = FEWER_NAMES, dropped=DROPPED, dropped_levels=DROPPED_LEVELS, kept=KEPT) -> DataFrame:
    """(name, center, additional_info) of augmented places by their first category.

    Its category is frequent enough and not dropped, neither is its second level; then its name is rare enough; then,
    of some second levels, only certain last parts stay.
    """
    first = rows.withColumn("category", F.get("categories", F.lit(0))).drop("categories")
    often = P.frequent(first, "category", more_than).filter(~F.col("category").isin(*dropped))
    often = often.withColumn("level", P.second_level(F.col("category"))).filter(~F.col("level").isin(*dropped_levels)).drop("category_count")
    rare = P.seldom(often, "name", fewer_names)
    wanted = ~F.col("level").isin(*kept)
    for level, last in kept.items():
        wanted = wanted | ((F.col("level") == level) & P.last_segment(F.col("category")).isin(*last))
    return rare.filter(wanted).select("name", "center", "additional_info")


def clean_dump(spark: SparkSession, dump: str, region: str, augmented_path: str, search_path: str) -> None:
    """The whole job of one region: reads a dump, writes the augmented places and, from these, the places to search."""
    writers.json_lines(augmented(readers.place_dump(spark, dump), region), augmented_path)
    writers.json_lines(search_places(readers.augmented_places(spark, augmented_path)), search_path)
