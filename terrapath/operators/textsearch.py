"""Name search: exact, by prefix and by edit distance, as joins on short keys.

A query within k edits of a prefix of a name shares, cut into k + 1 pieces, at least one piece unchanged
with that prefix, shifted by at most k. Joining on pieces keeps the candidates few without a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import allowed_edits, prefix_distance

ANSWERS = 10


def exact(names: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (query) that equal a name."""
    return queries.join(names.select(F.col("name").alias("query")).distinct(), "query", "left_semi")


def continuations(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, name) for every distinct name that begins with the query, joined on the first letters."""
    keyed = names.select("name").distinct().withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.substring("name", F.lit(1), i))))
    return keyed.join(queries.select("query", F.col("query").alias("key")).distinct(), "key").select("query", "name")


def _pieces(text, k):
    """(number, start, piece) of a text cut into k + 1 pieces of near equal length."""
    n = F.length(text)

    def cut(i):
        a, b = F.floor(n * i / (k + 1)), F.floor(n * (i + 1) / (k + 1))
        return F.struct(i.alias("i"), a.cast("int").alias("start"), F.substring(text, (a + 1).cast("int"), (b - a).cast("int")).alias("piece"))

    return F.transform(F.sequence(F.lit(0), k), cut)


def _distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def _with_edits(queries: DataFrame, edits: int | None) -> DataFrame:
    return _distinct(queries, "query").withColumn("k", F.lit(edits) if edits is not None else allowed_edits("query"))


def _sharing_a_piece(q: DataFrame, n: DataFrame) -> DataFrame:
    """(query, k, name) of names that may have a prefix within k edits of a query of more than k letters."""
    parts = q.withColumn("p", F.explode(_pieces(F.col("query"), F.col("k")))).select("query", "k", "p.start", "p.piece")
    sought = parts.withColumn("at", F.explode(F.sequence(F.greatest(F.col("start") - F.col("k"), F.lit(0)), F.col("start") + F.col("k")))).select("query", "k", "at", "piece")
    sizes = parts.select(F.length("piece").alias("size")).distinct()
    grams = n.join(F.broadcast(sizes), F.col("size") <= F.length("name"))  # as many rows as there are piece lengths
    keyed = grams.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("name") - F.col("size")))).select("name", "at", F.substring("name", F.col("at") + 1, F.col("size")).alias("piece"))
    return sought.join(keyed, ["at", "piece"]).select("query", "k", "name").distinct()


def within_edits(names: DataFrame, queries: DataFrame, edits: int | None = None) -> DataFrame:
    """(query, name, distance) for names of which a prefix is within the query's allowed edits.

    Without ``edits`` a query of n bytes may have n / 4 edits, at least 2. A query with no more letters than
    edits matches every name, so the result itself is a row for each; ``best_matches`` doesn't need them all.
    """
    q, n = _with_edits(queries, edits), _distinct(names, "name")
    pairs = _sharing_a_piece(q.filter(F.length("query") > F.col("k")), n)
    short = q.filter(F.length("query") <= F.col("k")).crossJoin(n)
    return pairs.unionByName(short).withColumn("distance", prefix_distance("query", "name")).filter(F.col("distance") <= F.col("k")).select("query", "name", "distance")


def whole_within(names: DataFrame, queries: DataFrame, edits: int, exactly: bool = False) -> DataFrame:
    """(query, name, distance) for names within so many edits of the query as a whole, or exactly so many."""
    q, n = _with_edits(queries, edits), _distinct(names, "name")
    pairs = _sharing_a_piece(q.filter(F.length("query") > edits), n)
    # A query of no more letters than edits: names of no more than twice as many letters, by their length.
    short = q.filter(F.length("query") <= edits).withColumn("size", F.explode(F.sequence(F.lit(0), F.length("query") + edits)))
    pairs = pairs.unionByName(short.join(n.withColumn("size", F.length("name")), "size").select("query", "k", "name"))
    found = pairs.select("query", "name", F.levenshtein("query", "name").alias("distance"))
    return found.filter(F.col("distance") == edits if exactly else F.col("distance") <= edits)


def best_matches(names: DataFrame, queries: DataFrame, edits: int | None = None, answers: int = ANSWERS) -> DataFrame:
    """The first answers of each query, by distance, length and name, numbered from 0.

    Every name is as many edits away from a short query as that has letters, or fewer: those with fewer are found
    by pieces, and of the others only the first by length and name can be answers.
    """
    q, n = _with_edits(queries, edits), _distinct(names, "name")
    short = q.filter(F.length("query") <= F.col("k"))
    near = q.filter(F.length("query") > F.col("k")).unionByName(short.filter(F.length("query") > 0).withColumn("k", F.length("query") - 1))
    first = n.orderBy(F.length("name"), "name").limit(answers)
    pairs = _sharing_a_piece(near, n).select("query", "name").unionByName(short.select("query").crossJoin(F.broadcast(first))).distinct()
    found = pairs.withColumn("distance", prefix_distance("query", "name")).join(q, "query").filter(F.col("distance") <= F.col("k")).select("query", "name", "distance")
    order = Window.partitionBy("query").orderBy("distance", F.length("name"), "name")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).filter(F.col("rank") < answers)


def prefix_counts(names: DataFrame) -> DataFrame:
    """(prefix, n, rank): names below each prefix, and its place among its siblings, the largest first."""
    cut = names.select("name").distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", F.lit(1), i))))
    counted = cut.groupBy("prefix").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("name"))).alias("lengths"))
    parent = F.expr("substring(prefix, 1, length(prefix) - 1)")
    order = Window.partitionBy(parent).orderBy(F.desc("n"), "prefix")
    return counted.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))
