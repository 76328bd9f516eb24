"""Numbers of rows in one order of the whole table, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds each row's place, from 0, in the order of the columns ``by``.

    Rows are dealt into ranges of the order; a range numbers its own and adds the counts of those before it, of
    which there is one number per range. Rows that are equal in ``by`` come in any order.
    """
    parts = written(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets += [F.lit(part), F.lit(total).cast("long")]
        total += n
    base = F.try_element_at(F.create_map(*offsets) if offsets else F.create_map().cast("map<int,bigint>"), F.col("__part"))
    return parts.withColumn(name, base + F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1).drop("__part")
