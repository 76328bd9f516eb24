"""Queries on places: categories, names, labels, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import request_value
from ..operators import placejob as J
from ..operators import places as P
from . import inputs as I

MORE_THAN, JOB_MORE_THAN = 10, 1
FEWER_NAMES = 32
DROPPED = ("osm.promo_burnished_copper", "osm.economy_anodized_steel")
KEPT = {"osm.standard_polished_brass": ("brand_13", "brand_22"), "osm.small_plated_copper": ("brand_11", "brand_31")}
REPLACED = (("Customer", "Site"), ("#00000000", " "), ("Start", ""), ("  ", " "))
COUNTRIES = {"GERMANY": "Germany", "FRANCE": "France", "INDIA": "India"}


def places_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent categories among frequent, not excluded ones."""
    df = P.frequent(I.categories(spark, sf_dir), "category", MORE_THAN)
    kept = df.filter(~P.second_level(F.col("category")).isin(*DROPPED))
    return kept.groupBy("category").agg(F.count("*").alias("n"), F.min("name").alias("first_name")).orderBy(F.desc("n"), "category").limit(10)


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.counts(I.categories(spark, sf_dir), "category")


def category_second_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.categories(spark, sf_dir).withColumn("level2", P.second_level(F.col("category")))
    return P.counts(df, "level2")


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per category, per second level and in total."""
    df = I.categories(spark, sf_dir).select(P.second_level(F.col("category")).alias("level2"), P.last_segment(F.col("category")).alias("last"))
    return df.rollup("level2", "last").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def rare_category_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.category_lists(spark, sf_dir)
    return P.without_rare(df, "categories", "p_partkey").select("p_partkey", "name", F.get("categories", F.lit(0)).alias("first_category"))


def name_counts_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.seldom(I.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), "name", FEWER_NAMES)


def place_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of which no category equals or begins with an excluded one."""
    df = I.category_lists(spark, sf_dir)
    bad = P.matches_any(F.col("categories"), ["osm.rare.*", f"{DROPPED[0]}.*", "osm.standard_polished_brass.brand_13"])
    return df.filter(~bad).select("p_partkey", F.size("categories").alias("n_categories"))


def place_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with a name and of a wanted type, typed as start or landing, with parsed coordinates."""
    text = F.concat(F.col("lon").cast("decimal(8,3)").cast("string"), F.lit(", "), F.col("lat").cast("decimal(8,3)").cast("string"))
    df = I.sites(spark, sf_dir).withColumn("type", (F.col("id") % 3 + 1).cast("string")).withColumn("name", F.when(F.col("id") % 11 != 0, F.col("name")))
    kept = df.filter(F.col("name").isNotNull() & (F.col("type") != "3"))
    return kept.select(
        "id", F.when(F.col("type") == "1", "Start").otherwise("Landing").alias("label"),
        F.round(P.lon_lat(text)[0].cast("double"), 3).alias("lon"), F.round(P.lon_lat(text)[1].cast("double"), 3).alias("lat"),
    )


def keep_rules_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per second level only the last segments that a rule lists: one predicate instead of a union of filters."""
    df = I.categories(spark, sf_dir)
    level2, last = P.second_level(F.col("category")), P.last_segment(F.col("category"))
    rules = F.lit(False)
    for key, suffixes in KEPT.items():
        rules = rules | ((level2 == key) & last.isin(*suffixes))
    return df.filter(rules | ~level2.isin(*KEPT)).groupBy(level2.alias("level2"), last.alias("last")).agg(F.count("*").alias("n"))


def context_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = I.table(spark, sf_dir, "nation").join(I.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    state = F.when(F.col("n_nationkey") % 4 == 0, F.create_map(F.lit("state:en"), F.concat(F.lit("State "), F.col("n_nationkey").cast("string"))))
    label = P.context_label(F.coalesce(state, F.create_map().cast("map<string,string>")), F.col("n_name"), COUNTRIES, F.col("r_name"))
    return n.select(F.col("n_nationkey"), label.alias("label"))


def name_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several names; empty where there is none."""
    k, name = F.col("p_partkey"), F.col("p_name")
    pairs = F.array(
        F.when(k % 4 == 0, F.struct(F.lit("name:fr").alias("k"), F.concat(F.lit("fr "), name).alias("v"))),
        F.when(k % 3 == 0, F.struct(F.lit("name:de").alias("k"), F.concat(F.lit("de "), name).alias("v"))),
        F.when(k % 5 == 0, F.struct(F.lit("name").alias("k"), name.alias("v"))),
    )
    names = F.map_from_entries(F.array_compact(pairs))
    return I.table(spark, sf_dir, "part").select("p_partkey", P.best_name(names).alias("name"))


def clean_site_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sites(spark, sf_dir).select("id", P.replaced(F.col("name"), REPLACED).alias("name"))


def dictionary_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as dictionary numbers in the order of first occurrence, and decoded again."""
    df = I.sites(spark, sf_dir)
    words = P.dictionary(df, "kind", "id")
    coded = df.join(words, "kind").select("id", "ix")
    return coded.join(words, "ix").select("id", "ix", "kind")


def place_search_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both steps of the cleaning job on places made of parts: names, centres, categories, labels."""
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, F.lit("at")).when(k % 5 == 1, F.lit("xx"))
    address = F.when(k % 7 == 0, F.create_map(F.lit("state:en"), F.concat(F.lit("State "), (k % 3).cast("string"))))
    shape = F.when(k % 2 == 0, F.struct(F.lit("Point").alias("type"), F.parse_json(F.concat(F.lit("["), (k % 90).cast("string"), F.lit(","), (k % 45).cast("string"), F.lit("]"))).alias("coordinates"))).otherwise(
        F.struct(F.lit("LineString").alias("type"), F.parse_json(F.concat(F.lit("[["), (k % 90).cast("string"), F.lit(",1],["), (k % 80).cast("string"), F.lit(",2]]"))).alias("coordinates"))
    )
    names = F.when(k % 11 != 0, F.create_map(F.when(k % 3 == 0, F.lit("name:de")).otherwise(F.lit("name")), F.col("name")))
    listed = I.category_lists(spark, sf_dir)
    places = listed.select(names.alias("name"), "categories", F.when(k % 4 == 0, F.array((k % 10).cast("double"), (k % 20).cast("double"))).alias("centroid"), address.alias("address"), code.alias("country_code"), shape.alias("geometry"))
    found = J.search_places(J.augmented(places, "Nowhere"), JOB_MORE_THAN, FEWER_NAMES, ("osm.small_plated_copper.brand_11",), DROPPED, KEPT)
    return found.select("name", F.col("center")[0].alias("x"), F.col("center")[1].alias("y"), "additional_info")


def geometry_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the ring of points around a site, and the same sum divided by the number of rings."""
    df = I.sites(spark, sf_dir)
    ring = F.transform(F.array(*(F.lit(float(i)) for i in range(4))), lambda i: F.array(F.col("lon") + i, F.col("lat") + 2 * i))
    mean, compat = P.centre(ring), P.centre(ring, F.lit(1))
    return df.select("id", F.round(mean[0], 6).alias("x"), F.round(mean[1], 6).alias("y"), F.round(compat[0], 6).alias("x_sum"), F.round(compat[1], 6).alias("y_sum"))


def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search parameters from requests: defaults, clamps, rounding and units."""
    k = F.col("o_orderkey")
    p = I.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 3 != 0, (k % 400).cast("double")).alias("cell"), F.when(k % 4 != 0, (k % 150) / F.lit(10.0)).alias("glide"),
        F.when(k % 5 != 0, (k % 7200) / F.lit(20.0)).alias("wind_deg"), F.when(k % 7 != 0, (k % 300).cast("double")).alias("wind_kmh"),
    )
    return p.select(
        "o_orderkey", request_value("cell", 200.0, 10.0, 1000.0).alias("cell"), F.round(1 / request_value("glide", 8.0, 1.0, 100.0), 4).alias("ratio"),
        F.round(F.radians(request_value("wind_deg", 0.0, 0.0, 360.0)), 4).alias("wind_rad"), F.round(request_value("wind_kmh", 0.0, 0.0, 200.0) / 3.6, 4).alias("wind_ms"),
    )


QUERIES = (
    places_filtered_topk, category_counts, category_second_level, category_rollup, rare_category_antijoin, name_counts_filter, place_blacklist,
    place_required_fields, keep_rules_union, context_label, name_priority, clean_site_name, dictionary_encode_decode, place_search_job, geometry_center, request_defaults,
)

_L2 = "array_to_string(string_split(category, '.')[1:2], '.')"
_LAST = "string_split(category, '.')[-1]"
_NOT = ", ".join(f"'{x}'" for x in DROPPED)
_RULES = " OR ".join(f"({_L2} = '{k}' AND {_LAST} IN ({', '.join(repr(x) for x in v)}))" for k, v in KEPT.items())
_CLEAN = "name"
for _a, _b in REPLACED:
    _CLEAN = f"replace({_CLEAN}, '{_a}', '{_b}')"
_CASES = " ".join(f"WHEN n_name = '{k}' THEN '{v}'" for k, v in COUNTRIES.items())

SQL = {
    "places_filtered_topk": f"""SELECT category, count(*) AS n, min(name) AS first_name FROM (SELECT *, count(*) OVER (PARTITION BY category) AS k FROM {I.CATEGORIES})
 WHERE k > {MORE_THAN} AND {_L2} NOT IN ({_NOT}) GROUP BY category ORDER BY n DESC, category LIMIT 10""",
    "category_counts": f"SELECT category, count(*) AS n FROM {I.CATEGORIES} GROUP BY category",
    "category_second_level": f"SELECT {_L2} AS level2, count(*) AS n FROM {I.CATEGORIES} GROUP BY 1",
    "category_rollup": f"""SELECT level2, last, count(*) AS n, cast(grouping(level2, last) AS int) AS level
 FROM (SELECT {_L2} AS level2, {_LAST} AS last FROM {I.CATEGORIES}) GROUP BY ROLLUP (level2, last)""",
    "rare_category_antijoin": f"""WITH x AS (SELECT p_partkey, unnest(categories) AS k FROM {I.CATEGORY_LISTS}),
 rare AS (SELECT k FROM x GROUP BY k HAVING count(*) = 1)
 SELECT p_partkey, name, categories[1] AS first_category FROM {I.CATEGORY_LISTS} WHERE p_partkey NOT IN (SELECT p_partkey FROM x WHERE k IN (SELECT k FROM rare))""",
    "name_counts_filter": f"SELECT name, p_partkey, name_count FROM (SELECT p_partkey, p_name AS name, count(*) OVER (PARTITION BY p_name) AS name_count FROM part) WHERE name_count < {FEWER_NAMES}",
    "place_blacklist": f"""SELECT p_partkey, cast(len(categories) AS int) AS n_categories FROM {I.CATEGORY_LISTS}
 WHERE len(list_filter(categories, lambda x: starts_with(x, 'osm.rare') OR starts_with(x, '{DROPPED[0]}') OR x = 'osm.standard_polished_brass.brand_13')) = 0""",
    "place_required_fields": f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'Start' ELSE 'Landing' END AS label, round(lon, 3) AS lon, round(lat, 3) AS lat FROM {I.SITES} WHERE id % 11 <> 0 AND id % 3 <> 2""",
    "keep_rules_union": f"SELECT {_L2} AS level2, {_LAST} AS last, count(*) AS n FROM {I.CATEGORIES} WHERE ({_RULES}) OR {_L2} NOT IN ({', '.join(repr(x) for x in KEPT)}) GROUP BY 1, 2",
    "context_label": f"""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'State ' || n_nationkey {_CASES} ELSE r_name END AS label
 FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "name_priority": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN 'de ' || p_name WHEN p_partkey % 4 = 0 THEN 'fr ' || p_name ELSE '' END AS name FROM part",
    "clean_site_name": f"SELECT id, trim({_CLEAN}) AS name FROM {I.SITES}",
    "dictionary_encode_decode": f"""WITH s AS (SELECT * FROM {I.SITES}), d AS (SELECT kind, cast(row_number() OVER (ORDER BY min(id)) - 1 AS bigint) AS ix FROM s GROUP BY kind)
 SELECT id, ix, kind FROM s JOIN d USING (kind)""",
    "geometry_center": f"SELECT id, round(lon + 1.5, 6) AS x, round(lat + 3.0, 6) AS y, round(4 * lon + 6, 6) AS x_sum, round(4 * lat + 12, 6) AS y_sum FROM {I.SITES}",
    "place_search_job": f"""WITH p AS (SELECT p_partkey AS k, categories, CASE WHEN p_partkey % 11 <> 0 THEN name END AS name FROM {I.CATEGORY_LISTS}),
 once AS (SELECT u FROM (SELECT unnest(categories) AS u FROM p) GROUP BY u HAVING count(*) = 1),
 a AS (SELECT name, categories[1] AS category, CASE WHEN k % 4 = 0 THEN (k % 10)::DOUBLE WHEN k % 2 = 0 THEN (k % 90)::DOUBLE ELSE (k % 90 + k % 80) / 2.0::DOUBLE END AS x,
 CASE WHEN k % 4 = 0 THEN (k % 20)::DOUBLE WHEN k % 2 = 0 THEN (k % 45)::DOUBLE ELSE 1.5::DOUBLE END AS y,
 CASE WHEN k % 7 = 0 THEN 'State ' || k % 3 WHEN k % 5 = 0 THEN 'Austria' ELSE 'Nowhere' END AS additional_info FROM p
 WHERE name IS NOT NULL AND k NOT IN (SELECT k FROM (SELECT k, unnest(categories) AS u FROM p) WHERE u IN (SELECT u FROM once))),
 b AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY category) AS n FROM a) WHERE n > {JOB_MORE_THAN} AND category <> 'osm.small_plated_copper.brand_11' AND {_L2} NOT IN ({_NOT})),
 c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name) AS m FROM b) WHERE m < {FEWER_NAMES})
 SELECT name, x, y, additional_info FROM c WHERE ({_RULES}) OR {_L2} NOT IN ({', '.join(repr(x) for x in KEPT)})""",
    "request_defaults": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN greatest(10.0::DOUBLE, least(1000.0::DOUBLE, o_orderkey % 400)) ELSE 200.0::DOUBLE END AS cell,
 round(1 / (CASE WHEN o_orderkey % 4 <> 0 THEN greatest(1.0::DOUBLE, least(100.0::DOUBLE, (o_orderkey % 150) / 10.0::DOUBLE)) ELSE 8.0::DOUBLE END), 4) AS ratio,
 round(radians(CASE WHEN o_orderkey % 5 <> 0 THEN greatest(0.0::DOUBLE, least(360.0::DOUBLE, (o_orderkey % 7200) / 20.0::DOUBLE)) ELSE 0.0::DOUBLE END), 4) AS wind_rad,
 round((CASE WHEN o_orderkey % 7 <> 0 THEN greatest(0.0::DOUBLE, least(200.0::DOUBLE, (o_orderkey % 300)::DOUBLE)) ELSE 0.0::DOUBLE END) / 3.6::DOUBLE, 4) AS wind_ms FROM orders""",
}
