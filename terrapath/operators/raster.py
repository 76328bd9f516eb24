"""Elevation grids in long form: one row (tile, r, c, h) per cell.

All operators work on every tile of the table at once; ``tile`` is part of every key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flight import MARGIN_COLOURS, colour_channel
from ..functions.geo import bbox_contains, coordinate_to_index

VOID_BELOW = -1000
OUTSIDE = 9999


def fill_voids(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each void (below -1000) takes the last sound height before it in row-major order of its tile.

    -1000 itself is sound. A tile that begins with a void keeps null there. Give the tile's key columns:
    each tile is ordered on its own, so the work spreads over tiles.
    """
    order = Window.partitionBy(*keys).orderBy("r", "c").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("h", F.last(F.when(F.col("h") >= VOID_BELOW, F.col("h")), ignorenulls=True).over(order))


def stats(cells: DataFrame, where: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Least and greatest height, and the box, of the cells that ``where`` selects."""
    chosen = cells if where is None else cells.filter(where)
    return chosen.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("h").alias("h_min"), F.max("h").alias("h_max"),
        F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"),
    )


def _target(line: str, n_old: int, n_new: int) -> Column:
    """The sample of n_new evenly spaced ones of n_old lines whose nearest line this is, or null; halves round away from zero.

    Samples lie one line apart or more, so it is one of the few around line / step.
    """
    step = (n_old - 1) / max(n_new - 1, 1)
    guess = F.floor(F.col(line) / F.lit(step or 1.0)).cast("int")
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: guess + d)
    return F.get(F.filter(near, lambda i: i.between(0, n_new - 1) & (F.round(i * F.lit(step)).cast("int") == F.col(line))), F.lit(0))


def resample(cells: DataFrame, rows: int, cols: int, factor_r: float, factor_c: float) -> DataFrame:
    """Nearest-neighbour resampling; factors above 1 count as 1.

    Every cell computes its place in the new grid, if it has one: no join, no shuffle.
    """
    new_r, new_c = (max(1, -int(-n * min(f, 1.0) // 1)) for n, f in ((rows, factor_r), (cols, factor_c)))
    placed = cells.withColumns({"to_r": _target("r", rows, new_r), "to_c": _target("c", cols, new_c)})
    return placed.filter("to_r is not null and to_c is not null").select("tile", F.col("to_r").alias("r"), F.col("to_c").alias("c"), "h")


def squared(cells: DataFrame, rows: int, cols: int, row_m: float, col_m: float) -> tuple[DataFrame, float]:
    """Cells of ``row_m`` by ``col_m`` metres as square ones, and their side: the finer axis is thinned out."""
    side = max(row_m, col_m)
    return resample(cells, rows, cols, row_m / side, col_m / side), side


def crop(cells: DataFrame, r0: int, c0: int, rows: int, cols: int) -> DataFrame:
    """A window of each tile; cells outside the tile hold 9999."""
    frame = cells.select("tile").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    inner = cells.filter(F.col("r").between(r0, r0 + rows - 1) & F.col("c").between(c0, c0 + cols - 1))
    moved = inner.select("tile", (F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), "h")
    return frame.join(moved, ["tile", "r", "c"], "left").select("tile", "r", "c", F.coalesce("h", F.lit(OUTSIDE)).alias("h"))


def mosaic(cells: DataFrame, side: int, across: int) -> DataFrame:
    """Tiles, numbered row by row, as cells (gr, gc) of one grid ``across`` tiles wide."""
    return cells.withColumn("gr", (F.floor(F.col("tile") / across) * side + F.col("r")).cast("long")).withColumn("gc", (F.col("tile") % across * side + F.col("c")).cast("long"))


def lookup(points: DataFrame, cells: DataFrame, rows: int, cols: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Each point (id, lat, lon) with the height of its cell in a grid over ``box`` (south, west, north, east)."""
    s, w, n, e = box
    inside = points.filter(bbox_contains(s, w, n, e, "lat", "lon"))
    at = inside.select("id", "lat", "lon", coordinate_to_index("lat", rows, s, n).alias("r"), coordinate_to_index("lon", cols, w, e).alias("c"))
    return at.join(cells.select("r", "c", "h"), ["r", "c"])


def lookup_tiles(points: DataFrame, cells: DataFrame, side: int, across: int, box: tuple[float, float, float, float], tiles: tuple[int, int]) -> DataFrame:
    """(id, tile, r, c, h): each point of ``box`` (south, west, north, east) with the height of its cell.

    Tiles with ``side`` cells a side lie over the box in ``tiles[0]`` rows of ``tiles[1]``, numbered row by row with
    ``across`` to a row. The tile is derived from the point and is part of the join's key.
    """
    s, w, n, e = box
    inside = points.filter(bbox_contains(s, w, n, e, "lat", "lon"))
    at = inside.select("id", coordinate_to_index("lat", tiles[0] * side, s, n).alias("gr"), coordinate_to_index("lon", tiles[1] * side, w, e).alias("gc"))
    tile = F.floor(F.col("gr") / side) * across + F.floor(F.col("gc") / side)
    keyed = at.select("id", tile.cast("long").alias("tile"), (F.col("gr") % side).alias("r"), (F.col("gc") % side).alias("c"))
    return keyed.join(cells.select("tile", "r", "c", "h"), ["tile", "r", "c"]).select("id", "tile", "r", "c", "h")


#: Cells of a line that are looked up as one row.
RUN = 32


def lookup_cells(points: DataFrame, cells: DataFrame, side: int, across: int) -> DataFrame:
    """``points`` (id, gr, gc: a cell of the whole mosaic) with the height ``ground`` of their cell.

    Neither side is broadcast: Spark takes points that come from files for as small as these, which compress well. Cells are moved and ordered by runs of ``RUN``, and not one by one.
    """
    tile, run = F.floor(F.col("gr") / side) * across + F.floor(F.col("gc") / side), F.floor(F.col("c") / RUN)
    keyed = points.withColumns({"tile": tile.cast("long"), "r": F.pmod("gr", F.lit(side)).cast("int"), "c": F.pmod("gc", F.lit(side)).cast("int")}).withColumn("run", run)
    of_run = F.array_sort(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), "h"))).alias("x")
    runs = cells.groupBy(F.col("tile").cast("long").alias("tile"), "r", run.alias("run")).agg(of_run).select("tile", "r", "run", F.col("x.c").alias("in_run"), F.col("x.h").alias("heights"))
    met = keyed.join(runs.hint("merge"), ["tile", "r", "run"]).withColumn("at", F.array_position("in_run", F.col("c")).cast("int")).filter("at > 0")
    return met.withColumn("ground", F.get("heights", F.col("at") - 1)).drop("tile", "r", "c", "run", "in_run", "heights", "at")


def search_setup(points: DataFrame, cells: DataFrame, side: int, across: int, cell_m: float, glide: float, trim: float, wind: float, additional: float) -> DataFrame:
    """``points`` (id, gr, gc, and a start height that may be null) with ground, start height and reach in cells.

    A search starts at its own height, else ``additional`` above ground, never below ground; it can reach
    as far as that height lasts at the best glide, with the wind from behind.
    """
    at = lookup_cells(points, cells, side, across)
    height = F.greatest(F.coalesce("start_height", F.col("ground") + additional), F.col("ground")).cast("double")
    best = glide / ((wind + trim) / trim)
    return at.withColumn("height", height).withColumn("reach", F.floor((F.col("height") / best + 1) / cell_m).cast("int"))


#: Rows of cells that a window's join takes at once.
BAND = 64


def around(points: DataFrame, cells: DataFrame, side: int, across: int) -> DataFrame:
    """(id, r, c, h): the cells around each point (id, gr, gc, reach), over the borders of tiles.

    Rows and columns count from the window's corner, so the point is at (reach, reach). A window names the
    tiles and the bands of their rows that it touches, and the join is on these; where there is no tile there are no cells.
    """
    low, high = F.greatest(F.lit(0), F.col("gr") - F.col("reach")), F.col("gr") + F.col("reach")
    left, right = (F.floor((F.col("gc") + d * F.col("reach")) / side).cast("int") for d in (-1, 1))
    columns = F.filter(F.sequence(left, right), lambda x: x.between(0, across - 1))
    # A band never crosses a tile's border: it is counted within its row of tiles.
    in_tile = (side + BAND - 1) // BAND

    def band(row: Column) -> Column:
        return (F.floor(row / side) * in_tile + F.floor(row % side / BAND)).cast("int")

    named = points.filter(high >= 0).select("id", "gr", "gc", "reach", F.explode(F.sequence(band(low), band(high))).alias("band"), columns.alias("tcs"))
    named = named.withColumn("tc", F.explode("tcs")).withColumn("tr", F.floor(F.col("band") / in_tile).cast("int")).withColumn("tile", (F.col("tr") * across + F.col("tc")).cast("long"))
    keyed = cells.select(F.col("tile").cast("long").alias("tile"), F.col("r").alias("cr"), F.col("c").alias("cc"), "h").withColumn("band", (F.floor(F.col("tile") / across) * in_tile + F.floor(F.col("cr") / BAND)).cast("int"))
    if in_tile == 1:  # the band is the tile, and cells that are dealt by tile stay where they are
        met = named.drop("band").join(keyed.drop("band").hint("merge"), "tile")
    else:
        met = named.join(keyed.hint("merge"), ["tile", "band"])
    r = F.col("tr") * side + F.col("cr") - F.col("gr") + F.col("reach")
    c = F.col("tc") * side + F.col("cc") - F.col("gc") + F.col("reach")
    inside = met.select("id", "reach", r.cast("int").alias("r"), c.cast("int").alias("c"), "h")
    return inside.filter("r between 0 and 2 * reach and c between 0 and 2 * reach").select("id", "r", "c", "h")


def encode_rg(cells: DataFrame, rows: int) -> DataFrame:
    """Pixels of a height image: high and low byte in red and green, first row at the bottom."""
    h = F.greatest(F.lit(0), F.least(F.lit(65_535), F.col("h"))).cast("int")
    return cells.select("tile", F.col("c").alias("x"), (F.lit(rows - 1) - F.col("r")).alias("y"), F.shiftright(h, 8).alias("red"), h.bitwiseAND(255).alias("green"))


def decode_rg(pixels: DataFrame, rows: int) -> DataFrame:
    return pixels.select("tile", (F.lit(rows - 1) - F.col("y")).alias("r"), F.col("x").alias("c"), (F.col("red") * 256 + F.col("green")).alias("h"))


def agl_raw(nodes: DataFrame) -> DataFrame:
    """Raw pixels of height above ground: red and green hold it, blue says margin (128) or clear (255)."""
    agl = F.greatest(F.lit(0), F.col("agl")).cast("int")
    return nodes.select("tile", "r", "c", F.shiftright(agl, 8).alias("red"), agl.bitwiseAND(255).alias("green"), F.when(F.col("in_margin"), F.lit(128)).otherwise(F.lit(255)).alias("blue"))


def neighbours(cells: DataFrame) -> DataFrame:
    """(tile, r, c, h, nr, nc, nh): every cell with its neighbours to four sides, from a window over the columns and one over the rows."""
    column, row = Window.partitionBy("tile", "c").orderBy("r"), Window.partitionBy("tile", "r").orderBy("c")

    def side(f, w: Window, along: str, step: int) -> Column:
        there = f(F.struct("r", "c", "h")).over(w)
        return F.when(there[along] == F.col(along) + step, there)

    both = cells.select("tile", "r", "c", "h", side(F.lag, column, "r", -1).alias("down"), side(F.lead, column, "r", 1).alias("up"))
    every = both.select("*", side(F.lag, row, "c", -1).alias("left"), side(F.lead, row, "c", 1).alias("right"))
    one = every.select("tile", "r", "c", "h", F.explode(F.array_compact(F.array("down", "up", "left", "right"))).alias("n"))
    return one.select("tile", "r", "c", "h", F.col("n.r").alias("nr"), F.col("n.c").alias("nc"), F.col("n.h").alias("nh"))


def corners(cells: DataFrame) -> DataFrame:
    """Each cell with the heights of the next cells up, right and across, or its own at the edge.

    Two windows over the rows and columns of a tile; the diagonal is the next column's next row.
    """
    up = cells.withColumn("up", F.lead("h").over(Window.partitionBy("tile", "c").orderBy("r")))
    across = Window.partitionBy("tile", "r").orderBy("c")
    right = up.withColumn("right", F.lead("h").over(across)).withColumn("diag", F.lead("up").over(across))
    return right.select("tile", "r", "c", "h", *(F.coalesce(x, F.col("h")).alias(f"h_{x}") for x in ("up", "right", "diag")))


def placemarks(cells: DataFrame, span: tuple[int, int], keep_tile: bool = False) -> DataFrame:
    """A KML polygon with its colour (alpha, blue, green, red in hex) per cell of ``corners``, with its tile if asked for."""
    r, c = F.col("r"), F.col("c")
    points = ((c, r, "h"), (c + 1, r, "h_right"), (c + 1, r + 1, "h_diag"), (c, r + 1, "h_up"))
    ring = F.concat_ws(" ", *(F.concat_ws(",", x.cast("string"), y.cast("string"), F.col(h).cast("string")) for x, y, h in points))
    s = (F.col("h") - span[0]) / F.lit(float(span[1] - span[0]))
    red, green, blue = (colour_channel(s, i) for i in range(3))
    colour = F.format_string("96%02x%02x%02x", blue, green, red)
    style = F.concat(F.lit("</name><Style><PolyStyle><color>"), colour, F.lit("</color></PolyStyle></Style><Polygon><coordinates>"))
    body = F.concat(F.lit("<Placemark><name>"), F.concat_ws("_", r.cast("string"), c.cast("string")), style, ring, F.lit("</coordinates></Polygon></Placemark>"))
    keys = ["tile", "r", "c"] if keep_tile else ["r", "c"]
    return cells.select(*keys, body.alias("kml"), colour.alias("colour"))


def colour_image(nodes: DataFrame, value: Column, in_margin: Column, least: float | None = None) -> DataFrame:
    """(tile, x, y, red, green, blue, alpha): a picture of the box of each tile's positive values, the first row at the bottom.

    Values are scaled to their range; with ``least`` the scale begins there at the lowest and ends are clamped. A cell
    without a positive value is white and clear.
    """
    v = nodes.select("tile", "r", "c", value.cast("double").alias("v"), in_margin.alias("near"))
    box = v.filter("v > 0").groupBy("tile").agg(*(f(x).alias(f"{x}_{n}") for x in ("r", "c", "v") for n, f in (("min", F.min), ("max", F.max))))
    inside = v.join(box, "tile").filter("r between r_min and r_max and c between c_min and c_max")
    low = F.col("v_min") if least is None else F.greatest("v_min", F.lit(float(least)))
    s = F.try_divide(F.col("v") - low, F.col("v_max") - low)
    s = s if least is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    shown = F.col("v") > 0
    channels = [
        F.when(~shown | F.col("v").isNull(), 255).when(F.col("near"), colour_channel(F.col("s"), i, MARGIN_COLOURS)).otherwise(colour_channel(F.col("s"), i)).alias(name)
        for i, name in enumerate(("red", "green", "blue"))
    ]
    place = [(F.col("c") - F.col("c_min")).cast("int").alias("x"), (F.col("r_max") - F.col("r")).cast("int").alias("y")]
    return inside.withColumn("s", s).select("tile", *place, *channels, F.when(shown, 255).otherwise(0).alias("alpha"))


class _Sweep:
    """Straight glides from one cell to all cells of a tile, by directions.

    Around the start, directions are cut into narrow sectors. Only ground so high that it could stop a glide (or come into the margin) is
    entered, into all sectors that it may touch, by distance. A line is clear up to the first entry of its sector, and is sampled only where it passes
    entries, so a tile takes work about in proportion to its cells, and the answer is that of sampling each line whole.
    """

    #: Cells by which a sample lies off the middle of its cell at most.
    OFF = 0.7072

    def __init__(self, ground: np.ndarray, start: tuple[int, int], start_h: float, cell_m: float, glide: float, margin: float, start_distance: float) -> None:
        self.ground, self.start, self.start_h, self.cell_m, self.glide, self.margin, self.start_distance = ground, start, start_h, cell_m, glide, margin, start_distance
        self.sectors = 4 * max(ground.shape)

    def blocked(self, low: np.ndarray, flown: np.ndarray) -> np.ndarray:
        return self.start_h - flown * self.glide < low

    def near(self, low: np.ndarray, flown: np.ndarray) -> np.ndarray:
        return (flown >= self.start_distance) & (self.start_h - flown * self.glide - self.margin < low)

    def entries(self, margin: float, from_m: float) -> tuple[np.ndarray, np.ndarray]:
        """The ground that could come within ``margin`` of a glide from ``from_m`` on: where each sector's entries begin, and their distances, nearest first."""
        rows, cols = np.indices(self.ground.shape)
        dr, dc = rows - self.start[0], cols - self.start[1]
        dist = np.sqrt(dr * dr + dc * dc)
        could = (self.start_h - (dist - self.OFF) * self.cell_m * self.glide - margin < self.ground) | (self.start_h - (dist + self.OFF) * self.cell_m * self.glide - margin < self.ground)
        could &= (dist + self.OFF) * self.cell_m >= from_m
        dist, turn = dist[could], np.arctan2(dr[could], dc[could])
        half = np.where(dist > self.OFF, np.arcsin(np.minimum(1.0, self.OFF / np.maximum(dist, self.OFF))), np.pi) + 1e-9
        scale = self.sectors / (2 * np.pi)
        first = np.floor((turn - half) * scale).astype(np.int64)
        count = np.minimum(np.floor((turn + half) * scale).astype(np.int64) - first + 1, self.sectors)
        at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        sector, far = at % self.sectors, np.repeat(dist, count)
        order = np.lexsort((far, sector))
        return np.searchsorted(sector[order], np.arange(self.sectors + 1)), far[order]

    def hits(self, r: np.ndarray, c: np.ndarray, entries: tuple[np.ndarray, np.ndarray], bad) -> np.ndarray:
        """Which lines have a sample that is ``bad``."""
        begins, far = entries
        dr, dc = r - self.start[0], c - self.start[1]
        dist = np.sqrt(dr * dr + dc.astype(float) * dc)
        n = np.maximum(np.ceil(dist), 1).astype(np.int64)
        sector = np.floor(np.arctan2(dr, dc) * (self.sectors / (2 * np.pi))).astype(np.int64) % self.sectors
        at, end = begins[sector].copy(), begins[sector + 1]
        found = np.zeros(len(r), bool)
        live, done = np.arange(len(r)), np.full(len(r), -1)  # done: the last sample that was looked at
        while True:
            live = live[(at[live] < end[live])]
            live = live[far[at[live]] <= dist[live] + 1]
            if not len(live):
                return found
            step = np.maximum(dist[live], 1e-9) / n[live]
            lowest = np.maximum(np.floor((far[at[live]] - 2 * self.OFF) / step).astype(np.int64), done[live] + 1)
            highest = np.minimum(np.ceil((far[at[live]] + 2 * self.OFF) / step).astype(np.int64), n[live])
            for k in range(int(np.maximum(highest - lowest, -1).max()) + 1):
                i = lowest + k
                on = (i >= 0) & (i <= highest) & ~found[live]
                one, share = live[on], i[on] / n[live[on]]
                rows = np.floor(float(self.start[0]) + (r[one] - float(self.start[0])) * share + 0.5).astype(np.int64)
                cols = np.floor(float(self.start[1]) + (c[one] - float(self.start[1])) * share + 0.5).astype(np.int64)
                found[one] |= bad(self.ground[rows, cols], dist[one] * share * self.cell_m)
            done[live] = np.maximum(done[live], highest)
            at[live] += 1
            live = live[~found[live]]


def _looker(cell_m: float, glide: float, margin: float, start_distance: float):
    """The state of the line from a tile's start to each of its cells."""

    def run(t: pa.Table) -> pa.Table:
        r, c = (t.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
        r0, c0, start_h = (t.column(x)[0].as_py() for x in ("r0", "c0", "start_h"))
        ground = np.full((max(int(r.max()), r0) + 1, max(int(c.max()), c0) + 1), np.nan)
        ground[r, c] = t.column("h").to_pandas().to_numpy(float)
        look = _Sweep(ground, (r0, c0), start_h, cell_m, glide, margin, start_distance)
        blocked = look.hits(r, c, look.entries(0.0, 0.0), look.blocked)
        state = np.where(blocked, 2, 0)
        free = np.flatnonzero(~blocked)
        state[free] = look.hits(r[free], c[free], look.entries(margin, start_distance), look.near)
        dist = np.sqrt((r - r0) ** 2.0 + (c - c0) ** 2.0)
        names = pa.array(["clear", "margin", "blocked"]).take(pa.array(state))
        return pa.table({"tile": t.column("tile").cast(pa.int64()), "r": pa.array(r.astype(np.int32)), "c": pa.array(c.astype(np.int32)), "height": pa.array(start_h - dist * cell_m * glide), "state": names})

    return run


def sight(cells: DataFrame, start: tuple[int, int] | DataFrame, start_h: float | None, cell_m: float, glide: float, margin: float = 0.0, start_distance: float = 0.0) -> DataFrame:
    """(tile, r, c, height, state): each cell with the height at which a straight glide from its tile's start arrives.

    ``start`` is a cell of every tile, with ``start_h``, or a table (tile, r0, c0, start_h) of one start per tile at most; tiles without one are left out.
    A line is sampled once per cell of its length. It is blocked if a sample lies below ground, in the margin if one
    at ``start_distance`` or beyond has less than ``margin`` below it, else clear. A tile, of a fixed size by
    format, is one group: the samples of a cell lie anywhere between it and the start.
    """
    plain = cells.select("tile", "r", "c", "h")
    if isinstance(start, tuple):
        plain = plain.withColumns({"r0": F.lit(start[0]), "c0": F.lit(start[1]), "start_h": F.lit(float(start_h))})
    else:
        plain = plain.join(start.select("tile", F.col("r0").cast("int"), F.col("c0").cast("int"), F.col("start_h").cast("double")), "tile")
    found = plain.groupBy("tile").applyInArrow(_looker(cell_m, glide, margin, start_distance), "tile long, r int, c int, height double, state string")
    return found.withColumn("height", F.round("height", 6))


def line_of_sight(cells: DataFrame, start: tuple[int, int], start_h: float, cell_m: float, glide: float) -> DataFrame:
    """Cells of each tile that a straight glide from ``start`` reaches above the terrain."""
    return sight(cells, start, start_h, cell_m, glide).filter("state <> 'blocked'").drop("state")
