"""Queries on names: exact, by prefix, by edit distance; parameters and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import textsearch as T
from . import inputs as I


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of names with a letter changed: one per nation."""
    words = spark.createDataFrame([(i, w) for i, w in enumerate(("gold", "smull", "red", "lrge", "bolt", "stel", "xyz", "a"))], "i long, w string")
    nations = I.table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("n"), (F.col("n_nationkey") % 8).cast("long").alias("i"))
    typed = nations.join(F.broadcast(words), "i").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("w")).otherwise(F.substring("n", 1, 5)).alias("query"))
    return typed.distinct()


_WORDS = "(VALUES (0, 'gold'), (1, 'smull'), (2, 'red'), (3, 'lrge'), (4, 'bolt'), (5, 'stel'), (6, 'xyz'), (7, 'a'))"
_Q = f"(SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN w ELSE substring(lower(n_name), 1, 5) END AS query FROM nation JOIN {_WORDS} v(i, w) ON n_nationkey % 8 = i)"
_N = "(SELECT DISTINCT p_name AS name FROM part)"


def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _names(spark, sf_dir).select(F.col("name").alias("query")).unionByName(_queries(spark, sf_dir)).distinct()
    return T.exact(_names(spark, sf_dir), wanted)


def prefix_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin with a query, the shortest first."""
    found = T.continuations(_names(spark, sf_dir), _queries(spark, sf_dir))
    order = Window.partitionBy("query").orderBy(F.length("name"), "name")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def edit_distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.within_edits(_names(spark, sf_dir), _queries(spark, sf_dir))


def whole_name_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within eight edits of a query as a whole."""
    return T.whole_within(_names(spark, sf_dir), _queries(spark, sf_dir), 8)


def whole_name_edits_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names exactly nine edits from a query."""
    return T.whole_within(_names(spark, sf_dir), _queries(spark, sf_dir), 9, exactly=True)


def prefix_edit_distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.best_matches(_names(spark, sf_dir), _queries(spark, sf_dir))


def trie_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.prefix_counts(_names(spark, sf_dir)).select("prefix", "n", "rank", F.size("lengths").alias("n_lengths"), F.element_at("lengths", -1).alias("longest"))


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each first letter's names begin in the sorted list of names."""
    counted = _names(spark, sf_dir).distinct().groupBy(F.substring("name", 1, 1).alias("letter")).agg(F.count("*").alias("n"))
    return counted.withColumn("offset", F.sum("n").over(Window.orderBy("letter")) - F.col("n"))  # one row per letter


def short_query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of three letters or more, with their allowed edits."""
    return _queries(spark, sf_dir).filter(F.length("query") >= 3).select("query", X.allowed_edits("query").alias("edits"))


def share_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pairs = {"lat": (k % 90).cast("string"), "cell": F.when(k % 3 != 0, (k % 400).cast("string")), "name": F.concat(F.lit("a b/"), F.col("o_orderstatus"))}
    return I.table(spark, sf_dir, "orders").select("o_orderkey", X.share_url(pairs).alias("url"))


def snap_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return I.table(spark, sf_dir, "orders").select(
        "o_orderkey", X.snapped((k % 3001).cast("double"), 100.0).alias("height"), X.snapped((k % 203) / F.lit(10.0), 0.5).alias("glide"), F.split_part(F.concat((k % 64).cast("string"), F.lit(".png")), F.lit("."), F.lit(1)).cast("int").alias("y"),
    )


QUERIES = (exact_lookup, prefix_continuations, edit_distance_join, prefix_edit_distance_topk, whole_name_edits, whole_name_edits_exactly, trie_prefix_counts, running_offsets, short_query_filter, share_url, snap_parameters)

_K = "greatest(2, least(255, strlen(query) // 4))"
_EDIT = f"""(SELECT query, name, cast(list_min(list_transform(range(0, length(name) + 1), lambda i: levenshtein(query, substring(name, 1, i)))) AS int) AS distance, {_K} AS k FROM {_Q}, {_N})"""
SQL = {
    "exact_lookup": f"SELECT name AS query FROM {_N}",
    "prefix_continuations": f"SELECT query, name, cast(row_number() OVER (PARTITION BY query ORDER BY length(name), name) - 1 AS int) AS rank FROM {_Q} JOIN {_N} ON starts_with(name, query)",
    "edit_distance_join": f"SELECT query, name, distance FROM {_EDIT} WHERE distance <= k",
    "prefix_edit_distance_topk": f"""SELECT query, name, distance, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY query ORDER BY distance, length(name), name) - 1 AS int) AS rank FROM {_EDIT} WHERE distance <= k) WHERE rank < {T.ANSWERS}""",
    "whole_name_edits": f"SELECT * FROM (SELECT query, name, cast(levenshtein(query, name) AS int) AS distance FROM {_Q}, {_N}) WHERE distance <= 8",
    "whole_name_edits_exactly": f"SELECT * FROM (SELECT query, name, cast(levenshtein(query, name) AS int) AS distance FROM {_Q}, {_N}) WHERE distance = 9",
    "trie_prefix_counts": f"""SELECT prefix, n, cast(row_number() OVER (PARTITION BY substring(prefix, 1, length(prefix) - 1) ORDER BY n DESC, prefix) - 1 AS int) AS rank, cast(nl AS int) AS n_lengths, cast(longest AS int) AS longest
 FROM (SELECT substring(name, 1, i) AS prefix, count(*) AS n, count(DISTINCT length(name)) AS nl, max(length(name)) AS longest FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM {_N}) GROUP BY 1)""",
    "running_offsets": f"SELECT letter, n, cast(sum(n) OVER (ORDER BY letter) - n AS bigint) AS offset FROM (SELECT substring(name, 1, 1) AS letter, count(*) AS n FROM {_N} GROUP BY 1)",
    "short_query_filter": f"SELECT query, cast({_K} AS int) AS edits FROM {_Q} WHERE length(query) >= 3",
    "share_url": "SELECT o_orderkey, 'lat=' || (o_orderkey % 90) || CASE WHEN o_orderkey % 3 <> 0 THEN '&cell=' || (o_orderkey % 400) ELSE '' END || '&name=a+b%2F' || o_orderstatus AS url FROM orders",
    "snap_parameters": "SELECT o_orderkey, round((o_orderkey % 3001)::DOUBLE / 100) * 100 AS height, round((o_orderkey % 203) / 10.0::DOUBLE / 0.5::DOUBLE) * 0.5::DOUBLE AS glide, cast(o_orderkey % 64 AS int) AS y FROM orders",
}
