"""Requests: grids around a point with their metadata, searches made once each, rasters of what they reach, and searches that go on from a node.

A request names a cell (gr, gc) of the mosaic and, where it likes, its parameters. Requests of equal parameters share one search, and a store keeps
searches from call to call, so only those that nobody asked for before are made.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import exists, written
from .ordering import numbered
from .paths import backtrace
from .raster import lookup_cells
from .reach import DEFAULTS, reach

#: A request's numbers: default, least and greatest value (fixed values).
LIMITS = {
    "glide_number": (8.0, 1.0, 15.0),
    "additional_height": (10.0, 0.0, 1000.0),
    "wind_speed": (0.0, 0.0, 50.0),
    "wind_direction": (0.0, None, None),
    "trim_speed": (38.0, 0.0, 80.0),
    "safety_margin": (0.0, 0.0, None),
    "start_distance": (0.0, 0.0, None),
}
#: Metres around the point of a grid: default, least, greatest (fixed values).
GRID_MARGIN = (15_000.0, 1_000.0, 300_000.0)
#: What a raster holds where no glide comes (a fixed value).
NOWHERE = -1000.0
#: Degrees as JSON has them: six digits, and room for mosaics of any size, which go beyond 999 degrees where they are derived from keys.
DEGREE = "decimal(18,6)"
#: What makes two searches the same.
PARAMETERS = ("gr", "gc", "start_height", "additional_height", *DEFAULTS)


def _number(requests: DataFrame, name: str) -> Column:
    default, low, high = LIMITS[name]
    value = F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in requests.columns else F.lit(default)
    value = value if low is None else F.greatest(F.lit(low), value)
    return value if high is None else F.least(F.lit(high), value)


def parameters(requests: DataFrame) -> DataFrame:
    """(request_id, gr, gc, start_height, additional_height, and what ``reach`` takes, key): numbers that lack have their default, all are held within their limits.

    A compass direction that the wind comes from becomes the angle that it blows toward. ``key`` is the same for the same search.
    """
    start = F.col("start_height").cast("double") if "start_height" in requests.columns else F.lit(None).cast("double")
    named = requests.select(
        "request_id", F.col("gr").cast("int").alias("gr"), F.col("gc").cast("int").alias("gc"), start.alias("start_height"), _number(requests, "additional_height").alias("additional_height"),
        (1 / _number(requests, "glide_number")).alias("glide"), _number(requests, "trim_speed").alias("trim"), _number(requests, "wind_speed").alias("wind"),
        F.when(_number(requests, "wind_speed") == 0, 0.0).otherwise(F.lit(1.5 * math.pi) - F.radians(_number(requests, "wind_direction"))).alias("wind_dir"),
        _number(requests, "safety_margin").alias("margin"), _number(requests, "start_distance").alias("start_distance"),
    )
    exact = [(F.col(c) + F.lit(0.0)).alias(c) for c in PARAMETERS]  # no negative zero
    return named.withColumn("key", F.to_json(F.struct(*exact), {"ignoreNullFields": "false"}))


_SEARCHES = "key string, batch string, search_id long, gr int, gc int, ground double, height double"
_NODES = "search_id long, gr int, gc int, height double, dist double, ref_gr int, ref_gc int, near boolean"
_LINE = "array<struct<gc:int,height:double,agl:double,near:boolean>>"


def stored_searches(spark: SparkSession, store: str) -> DataFrame:
    """The searches of a store, one per key: of two that were made at the same time the first batch's."""
    if not exists(spark, f"{store}/searches"):
        return spark.createDataFrame([], _SEARCHES)
    one = F.min_by(F.struct("batch", "search_id", "gr", "gc", "ground", "height"), F.struct("batch", "search_id"))
    return spark.read.schema(_SEARCHES).parquet(f"{store}/searches").groupBy("key").agg(one.alias("s")).select("key", "s.*")


def stored_nodes(spark: SparkSession, store: str) -> DataFrame:
    """(batch, search_id, ...): the nodes of all batches; those of a batch that was never finished belong to no search."""
    if not exists(spark, f"{store}/nodes"):
        return spark.createDataFrame([], f"batch string, {_NODES}")
    return spark.read.schema(f"{_NODES}, batch string").parquet(f"{store}/nodes")


def search_once(requests: DataFrame, cells: DataFrame, side: int, across: int, cell_m: float, store: str) -> int:
    """Makes the searches of ``requests`` that ``store`` lacks, each once, and adds them to it. Returns how many.

    A request without ground is kept as a search that reaches nothing. The table of searches is written last: a batch that was broken
    off leaves nodes that no search names, and its searches are made anew.
    """
    spark = cells.sparkSession
    asked = parameters(requests).drop("request_id").dropDuplicates(["key"])
    fresh = written(asked.join(stored_searches(spark, store).hint("merge"), "key", "left_anti"), "asked")
    count = fresh.count()
    if not count:
        return 0
    batch = uuid.uuid4().hex
    named = written(numbered(fresh, ["key"], "search_id"), "asked")
    ground = lookup_cells(named.select("search_id", "gr", "gc"), cells, side, across).select("search_id", F.col("ground").cast("double").alias("ground"))
    height = F.greatest(F.coalesce("start_height", F.col("ground") + F.col("additional_height")), F.col("ground"))
    starts = written(named.join(ground.hint("merge"), "search_id", "left").withColumn("height", F.when(F.col("ground").isNotNull(), height)), "starts")
    reach(cells, starts, side, across, cell_m).write.parquet(f"{store}/nodes/batch={batch}")
    starts.withColumn("batch", F.lit(batch)).selectExpr(*(c.split()[0] for c in _SEARCHES.split(", "))).write.mode("append").parquet(f"{store}/searches")
    return count


def _answers(requests: DataFrame, store: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests with their search, the searches with the box of what they reach, and its nodes."""
    spark = requests.sparkSession
    found = parameters(requests).select("request_id", "key").join(stored_searches(spark, store).hint("merge"), "key").drop("key")
    wanted = found.select("batch", "search_id").distinct()
    nodes = stored_nodes(spark, store).join(wanted, ["batch", "search_id"], "left_semi")
    boxes = nodes.groupBy("batch", "search_id").agg(F.count("*").alias("n"), *(f(x).alias(f"{n}_{x}") for x in ("gr", "gc") for n, f in (("min", F.min), ("max", F.max))))
    return found, boxes, nodes


def answers(requests: DataFrame, store: str) -> DataFrame:
    """(request_id, rows, cols, start_r, start_c, ground, start_height, n): the raster of each request that reaches anything, in short."""
    found, boxes, _ = _answers(requests, store)
    span = [(F.col(f"max_{x}") - F.col(f"min_{x}") + 1).cast("int").alias(n) for x, n in (("gr", "rows"), ("gc", "cols"))]
    start = [(F.col(x) - F.col(f"min_{x}")).cast("int").alias(n) for x, n in (("gr", "start_r"), ("gc", "start_c"))]
    return found.join(boxes, ["batch", "search_id"]).select("request_id", *span, *start, "ground", F.col("height").alias("start_height"), "n")


def cones(requests: DataFrame, cells: DataFrame, side: int, across: int, cell_m: float, corner: tuple[float, float], degrees: tuple[float, float], store: str) -> tuple[DataFrame, DataFrame]:
    """What ``documents.cone_pieces`` writes: the metadata of each request that reaches anything, and its nodes.

    Indexes count from the corner of the box around what a request reaches. Metadata: request_id, rows, cols, start_r, start_c, start_height, cell_size, min_cell_size,
    angular_resolution (rows, columns), south, west, north, east. Nodes: r, c, height, dist, ref_r, ref_c (null at the start), ground. Both have the search
    (batch, search_id): the nodes of one that several requests share are there once.
    """
    found, boxes, nodes = _answers(requests, store)
    boxes, search = written(boxes, "boxes").hint("merge"), ["batch", "search_id"]
    size = {n: (F.col(f"max_{x}") - F.col(f"min_{x}") + 1).cast("int") for x, n in (("gr", "rows"), ("gc", "cols"))}
    start = {n: (F.col(x) - F.col(f"min_{x}")).cast("int") for x, n in (("gr", "start_r"), ("gc", "start_c"))}

    def degree(k: int, cell: Column) -> Column:
        return F.round(F.lit(corner[k]) + cell * degrees[k], 6).cast(DEGREE)

    edges = {"south": degree(0, F.col("min_gr")), "west": degree(1, F.col("min_gc")), "north": degree(0, F.col("max_gr") + 1), "east": degree(1, F.col("max_gc") + 1)}
    cell = {"cell_size": F.lit(cell_m), "min_cell_size": F.lit(cell_m), "angular_resolution": F.array(*(F.lit(d).cast(DEGREE) for d in degrees))}
    metas = found.join(boxes, search).withColumns(size | start | edges | cell).select("request_id", *search, *size, *start, F.col("height").alias("start_height"), *cell, *edges)
    known = lookup_cells(nodes.select(*search, "gr", "gc", "height", "dist", "ref_gr", "ref_gc"), cells, side, across).join(boxes, search)
    indexes = [(F.col(x) - F.col(f"min_{o}")).cast("int").alias(n) for x, o, n in (("gr", "gr", "r"), ("gc", "gc", "c"), ("ref_gr", "gr", "ref_r"), ("ref_gc", "gc", "ref_c"))]
    return metas, known.select(*search, *indexes, "height", "dist", "ground")


def rasters(requests: DataFrame, cells: DataFrame, side: int, across: int, store: str) -> DataFrame:
    """(request_id, r, c, height, agl, near): every cell of the box around what a request reaches; ``NOWHERE`` where no glide comes.

    Rows and columns count from the box's corner. A search's nodes are gathered once to the lines of its raster; requests meet lines, by merge, and only
    then are the cells between the nodes filled in, so no row per cell is moved and no table that grows is broadcast. A line has a row of the mosaic at most.
    """
    found, boxes, nodes = _answers(requests, store)
    known = lookup_cells(nodes.select("batch", "search_id", "gr", "gc", "height", "near"), cells, side, across)
    agl = F.coalesce(F.col("height") - F.col("ground"), F.lit(NOWHERE))
    lines = known.groupBy("batch", "search_id", "gr").agg(F.collect_list(F.struct("gc", "height", agl.alias("agl"), "near")).alias("known"))
    wanted = found.select("request_id", "batch", "search_id").join(boxes.hint("merge"), ["batch", "search_id"]).withColumn("gr", F.explode(F.sequence("min_gr", "max_gr")))
    drawn = wanted.join(lines.hint("merge"), ["batch", "search_id", "gr"], "left")

    def nowhere(gc: Column) -> Column:
        return F.struct(gc.alias("gc"), F.lit(NOWHERE).alias("height"), F.lit(NOWHERE).alias("agl"), F.lit(False).alias("near"))

    reached = F.coalesce("known", F.array().cast(_LINE))
    between = F.transform(F.array_except(F.sequence("min_gc", "max_gc"), F.transform(reached, lambda x: x["gc"])), nowhere)
    every = drawn.select("request_id", (F.col("gr") - F.col("min_gr")).alias("r"), "min_gc", F.explode(F.concat(reached, between)).alias("x"))
    return every.select("request_id", "r", (F.col("x.gc") - F.col("min_gc")).alias("c"), "x.height", "x.agl", "x.near")


def grids(requests: DataFrame, side: int, across: int, down: int, cell_m: float, corner: tuple[float, float], degrees: tuple[float, float]) -> DataFrame:
    """The grid that each request (request_id, gr, gc, margin_m, cell_size) gets, without its heights.

    It holds the cells within the margin, as far as there are tiles (``down`` rows of ``across``), thinned out to the cell size asked for, which is never finer than
    ``cell_m``. Columns: rows and cols, cell_size and min_cell_size, start_r and start_c (the middle), the box south, west, north, east (``corner`` being that of the mosaic, ``degrees`` those
    of a cell), and r0, c0, n_r, n_c, the cells of the mosaic that it is taken from. A request off the tiles has no grid.
    """
    default, low, high = GRID_MARGIN
    reach_cells = F.floor(F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.col("margin_m").cast("double"), F.lit(default)))) / cell_m).cast("int")
    at = requests.filter(F.col("gr").between(0, down * side - 1) & F.col("gc").between(0, across * side - 1)).withColumn("reach", reach_cells)
    for x, first, n, total in (("gr", "r0", "n_r", down * side), ("gc", "c0", "n_c", across * side)):
        at = at.withColumn(first, F.greatest(F.lit(0), F.col(x) - F.col("reach")).cast("int"))
        at = at.withColumn(n, (F.least(F.lit(total - 1), F.col(x) + F.col("reach")) - F.col(first) + 1).cast("int"))
    at = at.withColumn("cell_size", F.greatest(F.coalesce(F.col("cell_size").cast("double"), F.lit(cell_m)), F.lit(cell_m)))
    at = at.withColumns({n: F.ceil(F.col(old) * (F.lit(cell_m) / F.col("cell_size"))).cast("int") for n, old in (("rows", "n_r"), ("cols", "n_c"))})
    edges = {name: F.lit(corner[k]) + F.col(cell) * degrees[k] for name, k, cell in (("south", 0, "r0"), ("west", 1, "c0"))}
    edges |= {name: F.lit(corner[k]) + (F.col(cell) + F.col(n)) * degrees[k] for name, k, cell, n in (("north", 0, "r0", "n_r"), ("east", 1, "c0", "n_c"))}
    middle = {"start_r": F.floor(F.col("rows") / 2).cast("int"), "start_c": F.floor(F.col("cols") / 2).cast("int")}
    return at.withColumns(edges | middle | {"min_cell_size": F.lit(cell_m)}).select(
        "request_id", "rows", "cols", "cell_size", "min_cell_size", "start_r", "start_c", "south", "west", "north", "east", "r0", "c0", "n_r", "n_c"
    )


def _source(t: str, n_new: str, n_old: str) -> Column:
    """The old line that is nearest to line t of ``n_new`` evenly spaced ones."""
    return F.round(F.col(t) * ((F.col(n_old) - 1) / F.greatest(F.col(n_new) - 1, F.lit(1)))).cast("int")


def grid_heights(metas: DataFrame, cells: DataFrame, side: int, across: int) -> DataFrame:
    """(request_id, r, c, h): the heights of ``grids``; where there is no tile there are no cells.

    A grid meets each tile that it touches once, and tells for the tile's rows and columns which of its own lines take them. Cells stay where they are, and
    no row per cell of a grid is moved.
    """

    def lines(n_new: str, n_old: str, first: str, tile: str) -> Column:
        """Of each row or column of a tile the line of the grid that takes it, or null."""
        step = (F.col(n_old) - 1) / F.greatest(F.col(n_new) - 1, F.lit(1))

        def taker(i: Column) -> Column:
            old = F.col(tile) * side + i - F.col(first)
            guess = F.floor(F.coalesce(F.try_divide(old.cast("double"), step), F.lit(0.0))).cast("int")
            near = (F.greatest(F.lit(0), F.least(F.col(n_new) - 1, guess + d)) for d in (0, 1, -1))
            return F.coalesce(*(F.when(F.round(x * step).cast("int") == old, x) for x in near))  # lines lie one cell apart or more

        return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), taker)

    down, right = (F.explode(F.sequence(F.floor(F.col(x) / side).cast("int"), F.floor((F.col(x) + F.col(n) - 1) / side).cast("int"))) for x, n in (("r0", "n_r"), ("c0", "n_c")))
    touched = metas.select("request_id", "rows", "cols", "r0", "c0", "n_r", "n_c", down.alias("tr")).withColumn("tc", right)
    named = touched.select("request_id", (F.col("tr") * across + F.col("tc")).cast("long").alias("tile"), lines("rows", "n_r", "r0", "tr").alias("to_r"), lines("cols", "n_c", "c0", "tc").alias("to_c"))
    met = named.join(cells.select(F.col("tile").cast("long").alias("tile"), F.col("r").alias("cr"), F.col("c").alias("cc"), "h").hint("merge"), "tile")
    r, c = F.get("to_r", F.col("cr")), F.get("to_c", F.col("cc"))
    return met.filter(r.isNotNull() & c.isNotNull()).select("request_id", r.alias("r"), c.alias("c"), "h")


def middle_heights(metas: DataFrame, cells: DataFrame, side: int, across: int) -> DataFrame:
    """(request_id, r, c, h): of each of ``grids`` the middle cell alone, which is all that ``grid_metadata`` needs."""
    at = metas.select("request_id", "start_r", "start_c", (F.col("r0") + _source("start_r", "rows", "n_r")).alias("gr"), (F.col("c0") + _source("start_c", "cols", "n_c")).alias("gc"))
    return lookup_cells(at, cells, side, across).select("request_id", F.col("start_r").alias("r"), F.col("start_c").alias("c"), F.col("ground").alias("h"))


def grid_metadata(metas: DataFrame, heights: DataFrame) -> DataFrame:
    """The metadata of ``grids``, with the height of the middle cell; null where it has none."""
    middle = heights.select("request_id", F.col("r").alias("start_r"), F.col("c").alias("start_c"), F.col("h").alias("start_height"))
    return metas.drop("r0", "c0", "n_r", "n_c").join(middle, ["request_id", "start_r", "start_c"], "left")


def grid_faults(metas: DataFrame, heights: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, wanted, inside, outside, repeated, fault) of each grid: whether ``heights`` (key, r, c, h) fill its rows and columns, each cell once.

    The first of these that holds is the fault: cells outside, cells repeated, cells missing; else null. Cells of a grid that isn't among ``metas`` are a fault too.
    """
    cells = heights.groupBy(key, "r", "c").agg(F.count("*").alias("times")).withColumn("seen", F.lit(True))
    joined = metas.select(key, "rows", "cols").join(cells, key, "full_outer")
    fits = F.coalesce(F.col("seen") & F.col("r").between(0, F.col("rows") - 1) & F.col("c").between(0, F.col("cols") - 1), F.lit(False))
    out = joined.groupBy(key).agg(
        F.coalesce(F.max(F.col("rows").cast("long") * F.col("cols")), F.lit(0)).alias("wanted"), F.count(F.when(fits, 1)).alias("inside"),
        F.count(F.when(F.col("seen") & ~fits, 1)).alias("outside"), F.count(F.when(F.col("times") > 1, 1)).alias("repeated"),
    )
    fault = F.when(F.col("outside") > 0, "outside").when(F.col("repeated") > 0, "repeated").when(F.col("inside") < F.col("wanted"), "missing")
    return out.withColumn("fault", fault)


def sound_grids(metas: DataFrame, heights: DataFrame, key: str = "request_id") -> DataFrame:
    """``heights``, or an error that names a grid which they don't fill, raised before any row comes out."""
    bad = grid_faults(metas, heights, key).filter("fault is not null").limit(1).collect()
    if bad:
        raise ValueError(f"grid {bad[0][key]}: {bad[0]['fault']} cells, {bad[0]['inside']} of {bad[0]['wanted']}")
    return heights


def continued(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """Starts (search_id, gr, gc, height, from_search) of searches that go on from nodes: ``picks`` has (search_id, from_search, gr, gc).

    A search begins at the height at which the earlier one comes to that cell; a cell that it doesn't reach starts nothing.
    """
    at = nodes.select(F.col("search_id").alias("from_search"), "gr", "gc", "height")
    return picks.join(at, ["from_search", "gr", "gc"]).select("search_id", "gr", "gc", "height", "from_search")


def way_back(nodes: DataFrame, continuations: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, depth, id) from nodes back to the start of the first search, over all searches between; ids are (search_id, gr, gc).

    ``nodes`` are those of all searches, ``continuations`` as ``continued`` gives them, ``targets`` has (search_id, gr, gc). The start of a search that goes on has the
    node that it began at as its parent, so the trees of the searches are one tree. A search that goes on from itself, by whatever way, is an error.
    """
    own = F.struct("search_id", "gr", "gc")
    within = nodes.filter("ref_gr is not null").select(own.alias("id"), F.struct("search_id", F.col("ref_gr").alias("gr"), F.col("ref_gc").alias("gc")).alias("parent"))
    between = continuations.select(own.alias("id"), F.struct(F.col("from_search").alias("search_id"), "gr", "gc").alias("parent"))
    goes_on = continuations.select("search_id", "gr", "gc")
    roots = nodes.filter("ref_gr is null").join(goes_on, ["search_id", "gr", "gc"], "left_anti").select(own.alias("id"), F.lit(None).cast("struct<search_id:bigint,gr:int,gc:int>").alias("parent"))
    tree = written(within.unionByName(between).unionByName(roots), "tree")
    return backtrace(tree, targets.select(own.alias("id")))
