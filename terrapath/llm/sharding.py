"""K-d tree sharding: split at distributed weighted medians until each leaf holds its share of bytes.

Documents are points in metadata space (length, language, source). Per dimension, every unit (a
document, or a part of a group of equal texts) gets its rank by a distributed sort, so any cut is a
cut between two ranks. All nodes of one depth are split together: one aggregation finds each node's
widest dimension, and a few histogram passes over rank ranges find the weighted median there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ._common import materialize

SHARDS = 24
DIMS = ("length", "lang", "source")
#: Equal texts move as one unit up to this part of a shard's bytes; larger groups are cut into such units.
UNIT_SHARE = 0.005
#: Ranges into which one histogram pass divides the ranks of a node.
BINS = 2048
#: Buckets per shard that number their rows on their own.
SLOT_BUCKETS = 32


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, and the group's hash) of each row, with its metadata."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("g1"),
        F.xxhash64(F.lit(1), raw).alias("g2"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )


def _spot(name: str) -> Column:
    """A string's place in [0, 1): from its hash, so that no list of all values is needed."""
    return (F.xxhash64(name) / F.lit(2.0**64) + F.lit(0.5)).cast("double")


def units_of(rows: DataFrame, unit_bytes: int) -> DataFrame:
    """Rows with their unit: equal texts together, in pieces of about ``unit_bytes``.

    A row's piece comes from its id's hash and the group's size, so no group is gathered anywhere.
    """
    groups = rows.groupBy("g1", "g2").agg(
        F.sum("size").alias("group_bytes"), F.min("lang").alias("g_lang"), F.min("source").alias("g_source")
    )
    # At most all bytes / unit_bytes groups, or shards / UNIT_SHARE: they are broadcast, and no group's rows meet in a task.
    many = groups.filter(F.col("group_bytes") > unit_bytes).select("g1", "g2", F.ceil(F.col("group_bytes") / unit_bytes).cast("long").alias("pieces"))
    return (
        rows.join(F.broadcast(many), ["g1", "g2"], "left")
        .withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("long"))
        .drop("pieces")
    )


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; law ``bytes``.

    Shard sizes are equal up to a unit per cut. Equal texts share a shard unless their group is larger
    than a unit (half a percent of a shard), where a cut may fall between its units. A null text has 8
    bytes and counts as empty; null metadata counts as "". Repeated rows each get a slot. Fewer units
    than shards leave shards empty; an empty table gives an empty result. Other columns are not read.
    """
    rows = materialize(described(docs), "described")
    total = rows.agg(F.sum("size")).first()[0] or 0
    unit_bytes = max(1, int(total / shards * UNIT_SHARE))
    rows = materialize(units_of(rows, unit_bytes), "pieces")
    units = rows.groupBy("g1", "g2", "piece").agg(
        F.sum("size").alias("weight"), F.max("size").alias("length"), F.min("lang").alias("lang"), F.min("source").alias("source")
    )
    # A group's metadata must agree in all its pieces, so that they stay neighbours in every dimension.
    groups = units.groupBy("g1", "g2").agg(F.min("lang").alias("l"), F.min("source").alias("s"))
    units = units.drop("lang", "source").join(groups, ["g1", "g2"]).select(
        "g1", "g2", "piece", "weight", F.log1p(F.col("length").cast("double")).alias("length"), _spot("l").alias("lang"), _spot("s").alias("source")
    )
    for d in DIMS:
        units = numbered(units, [d, "g1", "g2", "piece"], f"{d}_rank")
    leaves = _split(materialize(units, "units"), shards)
    placed = rows.join(leaves.select("g1", "g2", "piece", "shard"), ["g1", "g2", "piece"], "left")
    return number(placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")).withColumn("grown_shard", F.lit(None).cast("int"))


def _split(units: DataFrame, shards: int) -> DataFrame:
    """Adds the leaf (``shard``) of each unit. A node is named by its first leaf."""
    nodes = {0: shards}
    span = units.agg(*(f(d).alias(f"{d}_{n}") for d in DIMS for n, f in (("min", F.min), ("max", F.max)))).first()
    width = {d: ((span[f"{d}_max"] or 0) - (span[f"{d}_min"] or 0)) or 1 for d in DIMS}
    at = units.withColumn("node", F.lit(0))
    while any(n > 1 for n in nodes.values()):
        open_nodes = at.filter(F.col("node").isin([k for k, n in nodes.items() if n > 1]))
        stats = open_nodes.groupBy("node").agg(
            F.sum("weight").alias("weight"),
            *(((F.max(d) - F.min(d)) / width[d]).alias(f"{d}_w") for d in DIMS),
            *(f(f"{d}_rank").alias(f"{d}_{n}") for d in DIMS for n, f in (("min", F.min), ("max", F.max))),
        ).collect()
        cuts = {}
        for r in stats:
            d = max(DIMS, key=lambda x: (r[f"{x}_w"], -DIMS.index(x)))
            left = nodes[r["node"]] // 2
            cuts[r["node"]] = {"dim": d, "lo": r[f"{d}_min"], "hi": r[f"{d}_max"], "before": 0, "want": r["weight"] * left / nodes[r["node"]]}
        _medians(open_nodes, cuts)
        step = F.col("node")
        for k, c in cuts.items():
            step = F.when((F.col("node") == k) & (F.col(f"{c['dim']}_rank") >= c["lo"]), k + nodes[k] // 2).otherwise(step)
        at = at.withColumn("node", step.cast("int"))
        if len(nodes) > 1:
            at = materialize(at, "nodes")
        nodes = {k: n for parent, all_n in nodes.items() for k, n in (((parent, all_n // 2), (parent + all_n // 2, all_n - all_n // 2)) if all_n > 1 else ((parent, all_n),))}
    return at.withColumnRenamed("node", "shard")


def _medians(units: DataFrame, cuts: dict[int, dict]) -> None:
    """Narrows each cut to one rank: units of ``lo`` and beyond go right.

    ``before`` is the weight below ``lo``; each pass keeps the range in which the wanted weight is met.
    """
    while any(c["lo"] < c["hi"] for c in cuts.values()):
        todo = {k: c for k, c in cuts.items() if c["lo"] < c["hi"]}
        rank, lo, hi, step = (F.lit(None).cast("long") for _ in range(4))
        for k, c in todo.items():
            mine = F.col("node") == k
            rank = F.when(mine, F.col(f"{c['dim']}_rank")).otherwise(rank)
            lo = F.when(mine, F.lit(c["lo"])).otherwise(lo)
            hi = F.when(mine, F.lit(c["hi"])).otherwise(hi)
            step = F.when(mine, F.lit(max(1, -(-(c["hi"] - c["lo"] + 1) // BINS)))).otherwise(step)
        bins = (
            units.select("node", "weight", rank.alias("rank"), lo.alias("lo"), hi.alias("hi"), step.alias("step"))
            .filter("rank between lo and hi")
            .groupBy("node", F.expr("(rank - lo) div step").alias("bin"))
            .agg(F.sum("weight").alias("weight"))
            .collect()
        )
        for k, c in todo.items():
            size = max(1, -(-(c["hi"] - c["lo"] + 1) // BINS))
            start = c["lo"]
            for b, w in sorted((r["bin"], r["weight"]) for r in bins if r["node"] == k):
                lo_b, hi_b = start + b * size, min(c["hi"], start + (b + 1) * size - 1)
                if c["before"] + w > c["want"]:
                    # In a range of one rank, the nearer side of the unit is the cut.
                    right = lo_b == hi_b and c["before"] + w - c["want"] < c["want"] - c["before"]
                    c["lo"], c["hi"] = (lo_b + 1, lo_b + 1) if right else (lo_b, hi_b)
                    break
                c["before"] += w
            else:
                c["lo"] = c["hi"] = c["hi"] + 1


def number(placed: DataFrame, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds gapless slots per shard: buckets of ids number their rows and add the counts of those before."""
    b = placed.withColumn("__b", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    counts = b.groupBy("shard", "__b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    place = F.row_number().over(Window.partitionBy("shard", "__b").orderBy("doc_id", "text_crc32")) - 1
    # At most shards * buckets rows, so the offsets are broadcast.
    return b.withColumn("__p", place).join(F.broadcast(counts), ["shard", "__b"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("__from") + F.col("__p")).cast("long").alias("slot")
    )
