"""SQL table functions over a session's views: bodies are plain queries, which Spark puts in the place of a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import requests, textsearch
from .text import BYTES_AN_EDIT, LEAST_EDITS, MOST_EDITS

#: Rows of an answer to ``fuzzy_search``.
ANSWERS = textsearch.ANSWERS


def register_fuzzy_search(spark: SparkSession, names: DataFrame) -> None:
    """``fuzzy_search(q)``: (name, distance, rank) of the first answers to q among ``names``, as ``textsearch.best_matches`` gives them.

    One query reads all names once; for many queries use ``best_matches``.
    """
    names.select("name").filter("name is not null").createOrReplaceTempView("fuzzy_search_names")
    nearest = "array_min(transform(sequence(0, length(name)), i -> levenshtein(q, substring(name, 1, i))))"
    allowed = f"greatest({LEAST_EDITS}, least({MOST_EDITS}, octet_length(q) div {BYTES_AN_EDIT}))"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION fuzzy_search(q STRING) RETURNS TABLE (name STRING, distance INT, rank INT)
        RETURN SELECT name, distance, CAST(row_number() OVER (ORDER BY distance, length(name), name) - 1 AS INT) FROM
        (SELECT name, distance FROM (SELECT name, {nearest} AS distance, {allowed} AS allowed FROM (SELECT DISTINCT name FROM fuzzy_search_names)) WHERE distance <= allowed
        ORDER BY distance, length(name), name LIMIT {ANSWERS})"""
    )


def register_glide_search(spark: SparkSession, store: str) -> None:
    """``glide_search(gr, gc, ...)``: the nodes of the stored search with these parameters (see ``requests.LIMITS``), none where nobody has asked for it."""
    # No column of the views is named like a parameter.
    requests.stored_searches(spark, store).selectExpr("key", "batch", "search_id").createOrReplaceTempView("glide_search_known")
    requests.stored_nodes(spark, store).withColumnsRenamed({"gr": "node_gr", "gc": "node_gc"}).createOrReplaceTempView("glide_search_nodes")

    def held(name: str) -> str:
        _, low, high = requests.LIMITS[name]
        value = name if low is None else f"greatest({low}D, {name})"
        return value if high is None else f"least({high}D, {value})"

    given = {
        "gr": "gr", "gc": "gc", "start_height": "start_height", "additional_height": held("additional_height"), "glide": f"1 / {held('glide_number')}", "trim": held("trim_speed"), "wind": held("wind_speed"),
        "wind_dir": f"CASE WHEN {held('wind_speed')} = 0 THEN 0.0D ELSE 1.5D * pi() - radians(wind_direction) END", "margin": held("safety_margin"), "start_distance": held("start_distance"),
    }
    key = ", ".join(f"'{k}', CAST({given[k]} AS DOUBLE) + 0.0D" for k in requests.PARAMETERS)
    defaults = ", ".join(f"{k} DOUBLE DEFAULT {v}D" for k, (v, _, _) in requests.LIMITS.items())
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION glide_search(gr INT, gc INT, start_height DOUBLE DEFAULT NULL, {defaults})
        RETURNS TABLE (node_gr INT, node_gc INT, height DOUBLE, dist DOUBLE, ref_gr INT, ref_gc INT, near BOOLEAN)
        RETURN SELECT n.node_gr, n.node_gc, n.height, n.dist, n.ref_gr, n.ref_gc, n.near FROM glide_search_nodes n JOIN glide_search_known s ON n.batch = s.batch AND n.search_id = s.search_id
        WHERE s.key = to_json(named_struct({key}), map('ignoreNullFields', 'false'))"""
    )
