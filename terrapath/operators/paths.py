"""Trees of path nodes: back-traces, profiles, delta coding and chunks.

Joins of nodes are by merge: Spark takes nodes and jumps for as small as their files, which compress well, and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .ordering import numbered

#: Rows of one chunk of the reduced stream (a fixed value).
CHUNK_ROWS = 20_000
#: Metres below the margin that don't count as in it (a fixed value).
TOLERANCE = 14.0


def _jumps(tree: DataFrame, targets: DataFrame) -> list[DataFrame]:
    """(at, to) of each node and the node 1, 2, 4, ... steps above it, as long as there is one."""
    nodes = tree.count()
    jump = written(tree.filter("parent is not null").select(F.col("id").alias("at"), F.col("parent").alias("to")), "jumps")
    out: list[DataFrame] = []
    while not jump.isEmpty():
        if 1 << len(out) > nodes:  # no path has so many legs
            if not targets.join(jump.hint("merge"), targets["id"] == jump["at"], "left_semi").isEmpty():
                raise ValueError("a path has a cycle")
            break
        out.append(jump)
        upper = jump.select(F.col("at").alias("to"), F.col("to").alias("top")).hint("merge")
        jump = written(jump.join(upper, "to").select("at", F.col("top").alias("to")), "jumps")
    return out


def backtrace(tree: DataFrame, targets: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(target, depth, id) of every node on the way from each target to its root, depth 0 at the target.

    Jumps of 1, 2, 4, ... steps are made by joining the jumps with themselves; each doubles the known part of all
    paths, so the joins grow with the logarithm of the depth. A path that comes back to a node it was at raises
    an error, as does one of more than ``most_steps`` legs.
    """
    path = targets.select(F.col("id").alias("target"), F.lit(0).alias("depth"), "id")
    for k, jump in enumerate(_jumps(tree, targets)):
        above = path.join(jump.hint("merge"), path["id"] == jump["at"]).select("target", (F.col("depth") + (1 << k)).alias("depth"), F.col("to").alias("id"))
        path = written(path.unionByName(above), "paths")
    if most_steps is not None and not path.filter(F.col("depth") > most_steps).isEmpty():
        raise ValueError(f"a path has more than {most_steps} legs")
    return path


def backtrace_sql(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """The same as a recursive query: one plan, whatever the depth (Spark bounds it at 100 levels) and, by LIMIT ALL, whatever the number of rows."""
    spark = tree.sparkSession
    return spark.sql(
        """WITH RECURSIVE walk AS (SELECT id AS target, 0 AS depth, id FROM {targets}
        UNION ALL SELECT w.target, w.depth + 1, t.parent FROM walk w JOIN {tree} t ON w.id = t.id WHERE t.parent IS NOT NULL) SELECT target, depth, id FROM walk LIMIT ALL""",
        tree=tree.select("id", "parent"),
        targets=targets.select("id"),
    )


def profile(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """Samples along each path (target, depth, id), from the start: one per cell of a leg's length.

    Height falls and distance grows linearly along a leg.
    """
    values = ("r", "c", "h", "dist")
    at = path.join(nodes.select("id", *values).hint("merge"), "id")
    legs = Window.partitionBy("target").orderBy(F.desc("depth"))
    pairs = at.select("target", "depth", *values, *(F.lead(x).over(legs).alias(f"{x}2") for x in values)).filter("r2 is not null")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(F.col("r2") - F.col("r"), 2) + F.pow(F.col("c2") - F.col("c"), 2)))).cast("int")
    t = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    steps = pairs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    r, c, h, dist = (F.col(x) + (F.col(f"{x}2") - F.col(x)) * t for x in values)
    return steps.select("target", "depth", "i", F.round(r).cast("int").alias("r"), F.round(c).cast("int").alias("c"), h.alias("h"), dist.alias("dist"))


def legs(tree: DataFrame) -> DataFrame:
    """(id, i, r, c, h, dist): the samples of ``profile`` of each node's leg from its parent, once, whatever paths take it."""
    values = ("r", "c", "h", "dist")
    up = tree.select(F.col("id").alias("parent"), *(F.col(x).alias(f"{x}1") for x in values)).hint("merge")
    pairs = tree.select("id", "parent", *values).join(up, "parent")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(F.col("r") - F.col("r1"), 2) + F.pow(F.col("c") - F.col("c1"), 2)))).cast("int")
    steps = pairs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    r, c, h, dist = (F.col(f"{x}1") + (F.col(x) - F.col(f"{x}1")) * t for x in values)
    return steps.select("id", "i", F.round(r).cast("int").alias("r"), F.round(c).cast("int").alias("c"), h.alias("h"), dist.alias("dist"))


def along(path: DataFrame, of_legs: DataFrame) -> DataFrame:
    """What is known of each leg (id, ...), for each path (target, depth, id) that takes it; depth is that of the leg's upper end."""
    return path.select("target", (F.col("depth") + 1).alias("depth"), "id").join(of_legs.hint("merge"), "id").drop("id")


def series(samples: DataFrame, ground: DataFrame, margin: float, start_distance: float) -> DataFrame:
    """Samples of ``profile`` or ``legs`` with ``ground`` (r, c, ground), height above it and the floor of the margin.

    Samples without known ground are left out. The floor is null before ``start_distance`` and without a margin.
    """
    known = samples.join(ground.select("r", "c", "ground").hint("merge"), ["r", "c"])
    floor = F.when((F.col("dist") >= start_distance) & F.lit(margin > 0), F.col("h") - margin)
    return known.withColumn("agl", F.col("h") - F.col("ground")).withColumn("floor", floor)


def margin_violations(series: DataFrame, margin: float, start_distance: float, by: str = "target") -> DataFrame:
    """Per path, or per leg by its ``id``, the range of its heights above ground and the distance of the first sample in the margin, or null.

    ``TOLERANCE`` metres in the margin don't count yet.
    """
    bad = (F.col("h") - margin + TOLERANCE < F.col("ground")) & (F.col("dist") >= start_distance)
    return series.groupBy(by).agg(F.min("agl").alias("agl_min"), F.max("agl").alias("agl_max"), F.min(F.when(bad, F.col("dist"))).alias("first_in_margin"))


def worst_of_legs(violations: DataFrame) -> DataFrame:
    """``margin_violations`` of each path from those of its legs (target, ...)."""
    return violations.groupBy("target").agg(F.min("agl_min").alias("agl_min"), F.max("agl_max").alias("agl_max"), F.min("first_in_margin").alias("first_in_margin"))


def reduced_stream(nodes: DataFrame) -> DataFrame:
    """Nodes in the order of their parent's distance, then their own, with repeated parents left out.

    (pos, chunk, id, parent): parent is null where it equals the row's before. Without a parent the distance
    is -1. Rows of one parent lie together, so a row repeats it unless it is the parent's first.
    """
    far = nodes.select(F.col("id").alias("parent"), F.col("dist").alias("parent_dist")).hint("merge")
    rows = nodes.select("id", "parent", "dist").join(far, "parent", "left")
    rows = rows.select("id", "parent", "dist", F.coalesce("parent_dist", F.lit(-1)).alias("parent_dist"), F.coalesce("parent", F.lit(-1)).alias("key"))
    first = rows.groupBy("key").agg(F.min(F.struct("dist", "id")).alias("first"))
    placed = numbered(rows.join(first.hint("merge"), "key"), ["parent_dist", "key", "dist", "id"], "pos")
    shown = F.when(F.struct("dist", "id") == F.col("first"), F.col("parent"))
    return placed.select("pos", F.floor(F.col("pos") / CHUNK_ROWS).cast("int").alias("chunk"), "id", shown.alias("parent"))


def delta_encode(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``value`` is null where it equals the row's before; ``first`` tells a group's first row."""
    w = Window.partitionBy(group).orderBy(order)
    same = F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)
    return rows.withColumn(value, F.when(~same, F.col(value)))


def delta_decode(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Carries the last value forward."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def crop_to_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with indexes counted from the corner of their bounding box."""
    box = nodes.agg(F.min("r").alias("r_min"), F.min("c").alias("c_min"))
    return nodes.crossJoin(F.broadcast(box)).select("id", (F.col("r") - F.col("r_min")).alias("r"), (F.col("c") - F.col("c_min")).alias("c"))  # one row
