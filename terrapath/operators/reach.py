"""Reach of glides over terrain by straight legs, as relaxation on blocks that exchange their borders.

Each reached cell has a reference: the cell where its last leg began. A cell takes over its neighbour's reference when the neighbour is
the next cell on the straight line to that reference and the glide from there is not below ground; else its leg begins at the neighbour.
Of what its eight neighbours offer a cell takes the greatest height (of equal ones the first reference), and nothing is offered that isn't lower than
the neighbour itself. As every height rests on greater ones only, these rules have one solution, whatever the order in which
they are applied: a block of cells is solved by itself for what its neighbours' borders hold, and blocks whose neighbours' borders changed are solved
again, until none do. References travel with the borders, so a leg may cross any number of blocks.

Ground is kept in blocks of ``BLOCK`` cells a side, read where a search could come; each search has its own glide, wind and margin.
Tables between the rounds are joined by merge: by the size of their files, which compress well, Spark would send ground, rims and searches to all executors, and
would solve all blocks of a round in one task. A row holds a block, so the rounds read few rows at once: thousands of them, as a reader takes by itself, fill an executor.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import arrow_batches, read_batches, written

#: Cells along one side of a block.
BLOCK = 128
#: Blocks that a task holds at once.
BATCH = 32
STEPS = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc)
#: What a search may bring along, and what holds where it doesn't.
DEFAULTS = {"glide": 1 / 8, "trim": 38.0, "wind": 0.0, "wind_dir": 0.0, "margin": 0.0, "start_distance": 0.0}
#: The reference row of a start.
ROOT = -(1 << 30)
_CELL = "r int, c int, h double, d double, pr int, pc int, hp double, dp double, near boolean"
_CELLS = f"array<struct<{_CELL.replace(' ', ':').replace(',:', ',')}>>"


def ratio(dr, dc, glide, trim, wind, wind_dir):
    """Height lost per distance on a leg of (dr, dc) cells, under wind that blows toward ``wind_dir`` (radians from the columns' axis, rows grow to the north); infinite against too much of it."""
    if not np.any(wind):
        return np.broadcast_to(glide, np.shape(dr))
    angle = np.arctan2(dr, dc) - wind_dir
    left = trim * trim - (np.sin(angle) * wind) ** 2
    speed = np.sqrt(np.maximum(left, 0)) + np.cos(angle) * wind
    with np.errstate(divide="ignore", invalid="ignore"):
        blown = np.where((left > 0) & (speed > 0), glide / (np.maximum(speed, 0) / trim), np.inf)
    return np.where(wind == 0, glide, blown)


class _Blocks:
    """Blocks of cells, one of one search each, with rims of their neighbours' borders, as one array of places."""

    STATE = ("h", "d", "pr", "pc", "hp", "dp", "near")

    def __init__(self, rows: list[dict], size: int, cell_m: float) -> None:
        self.size, self.cell_m, self.wide = size, cell_m, size + 2
        self.each = self.wide * self.wide
        self.top, self.left = (np.array([x[k] for x in rows], dtype=np.int64) * size - 1 for k in ("br", "bc"))
        self.p = {k: np.array([x[k] for x in rows]) for k in DEFAULTS}
        inner = (slice(None), slice(1, -1), slice(1, -1))
        ground, fixed = np.full((len(rows), self.wide, self.wide), np.inf), np.ones((len(rows), self.wide, self.wide), bool)
        for k, x in enumerate(rows):
            ground[k, 1:-1, 1:-1] = np.frombuffer(x["ground"]).reshape(size, size)
        fixed[inner] = False
        self.inner = ~fixed.ravel()
        self.ground, self.fixed = ground.ravel(), fixed.ravel()
        n = len(rows) * self.each
        self.h, self.d, self.hp, self.dp = np.full(n, -np.inf), np.zeros(n), np.zeros(n), np.zeros(n)
        self.pr, self.pc, self.near = np.full(n, ROOT), np.full(n, ROOT), np.zeros(n, bool)
        self.off = np.array([dr * self.wide + dc for dr, dc in STEPS])
        self.dr, self.dc = np.array(STEPS).T
        self.step_m = np.sqrt((self.dr * self.dr + self.dc * self.dc).astype(float)) * cell_m
        wind = [self.p[k][:, None] for k in ("glide", "trim", "wind", "wind_dir")]
        self.step_loss = self.step_m * ratio(np.broadcast_to(-self.dr, (len(rows), 8)), -self.dc, *wind)  # flown from the neighbour to the cell
        known = []
        for k, x in enumerate(rows):
            r, c = x["gr"] - self.top[k], x["gc"] - self.left[k]
            if 1 <= r <= size and 1 <= c <= size and x["height"] >= ground[k, r, c]:
                known.append(self.put(k, [{"r": x["gr"], "c": x["gc"], "h": x["height"], "d": 0.0, "pr": None, "pc": None, "hp": 0.0, "dp": 0.0, "near": False}]))
            known += [self.put(k, rim) for rim in x["rims"] or ()]
        self.solve(np.concatenate([np.zeros(0, np.int64), *known]))

    def put(self, k: int, cells: list[dict]) -> np.ndarray:
        """Cells of block k that are known from elsewhere; they stay as they are. Returns their places."""
        at = np.array([k * self.each + (x["r"] - self.top[k]) * self.wide + x["c"] - self.left[k] for x in cells], dtype=np.int64)
        for name in self.STATE:
            getattr(self, name)[at] = [ROOT if x[name] is None else x[name] for x in cells]
        self.fixed[at] = True
        return at

    def where(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block, row and column of places."""
        k, place = cells // self.each, cells % self.each
        return k, place // self.wide + self.top[k], place % self.wide + self.left[k]

    def offers(self, cells: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best offer of its neighbours to each cell: height, distance, reference, the reference's height and distance, margin."""
        near = cells[:, None] + self.off
        k, r, c = self.where(cells)
        p = {name: x[k][:, None] for name, x in self.p.items()}
        hy, pr, pc = self.h[near], self.pr[near], self.pc[near]
        vr, vc = pr - r[:, None], pc - c[:, None]
        most = np.maximum(np.maximum(np.abs(vr), np.abs(vc)), 1)
        leg = np.sqrt((vr * vr + vc * vc).astype(float)) * self.cell_m
        along = (pr != ROOT) & ((2 * vr + most) // (2 * most) == self.dr) & ((2 * vc + most) // (2 * most) == self.dc)
        ground = self.ground[cells][:, None]
        straight = self.hp[near] - leg * ratio(-vr, -vc, p["glide"], p["trim"], p["wind"], p["wind_dir"])
        take = along & (straight >= ground) & (straight < hy)
        bend = hy - self.step_loss[k]
        h = np.where(take, straight, np.where((bend >= ground) & (bend < hy), bend, -np.inf))
        ref_r, ref_c = np.where(take, pr, r[:, None] + self.dr), np.where(take, pc, c[:, None] + self.dc)
        best = np.lexsort((ref_c, ref_r, -h), axis=1)[:, 0]
        row = np.arange(len(cells))
        h, take, at = h[row, best], take[row, best], near[row, best]
        hp, dp = np.where(take, self.hp[at], self.h[at]), np.where(take, self.dp[at], self.d[at])
        d = dp + np.where(take, leg[row, best], self.step_m[best])
        margin = np.where(d >= p["start_distance"][:, 0], p["margin"][:, 0], 0.0)
        inside = self.near[at] | (h - margin < self.ground[cells])
        none = np.isneginf(h)
        return h, np.where(none, 0, d), np.where(none, ROOT, ref_r[row, best]), np.where(none, ROOT, ref_c[row, best]), np.where(none, 0, hp), np.where(none, 0, dp), inside & ~none

    def solve(self, known: np.ndarray) -> None:
        def around(cells: np.ndarray) -> np.ndarray:
            k, place = cells // self.each, cells % self.each
            found = place[:, None] + self.off
            found = np.where((found >= 0) & (found < self.each), found + (k * self.each)[:, None], cells[:, None])
            found = np.unique(found)
            return found[~self.fixed[found] & np.isfinite(self.ground[found])]

        active = around(known)
        state = [getattr(self, name) for name in self.STATE]
        while len(active):
            new = self.offers(active)
            changed = np.any([v != x[active] for v, x in zip(new, state, strict=True)], axis=0)
            at = active[changed]
            for x, v in zip(state, new, strict=True):
                x[at] = v[changed]
            active = around(at)

    def found(self, blocks: int) -> pa.Array:
        """Each block's own reached cells, row by row."""
        at = np.flatnonzero(self.inner & (self.h > -np.inf))
        k, r, c = self.where(at)
        root = self.pr[at] == ROOT
        columns = {"r": r, "c": c} | {name: getattr(self, name)[at] for name in self.STATE}
        fields = [pa.array(columns[f.name], f.type, mask=root if f.name in ("pr", "pc") else None) for f in _CELL_TYPE]
        ends = np.concatenate(([0], np.cumsum(np.bincount(k, minlength=blocks)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(_CELL_TYPE)))


_KINDS = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_CELL_TYPE = [pa.field(n, _KINDS[k]) for n, k in (x.split() for x in _CELL.split(", "))]


def _solver(size: int, cell_m: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = ["search_id", "br", "bc"]
            found = _Blocks(b.to_pylist(), size, cell_m).found(b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), found], names=[*names, "cells"])

    return run


def _blocks(cells: DataFrame, starts: DataFrame, side: int, across: int, cell_m: float, size: int) -> DataFrame:
    """(br, bc, ground): the ground of each block that a search could come to, row by row as 64-bit floats; infinite where there is none."""
    best = F.when(F.col("wind") == 0, F.col("glide")).otherwise(F.try_divide(F.col("glide") * F.col("trim"), F.col("wind") + F.col("trim")))
    lowest = cells.agg(F.min("h")).first()[0] or 0  # no glide goes below the lowest ground
    lasts = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.col("height") - float(lowest)), best), F.lit(0.0))
    far = F.least(F.ceil(lasts / cell_m), F.lit(across * side * 64)).cast("int")
    ranges = [F.explode(F.sequence(F.floor((F.col(x) - F.col("far")) / size).cast("int"), F.floor((F.col(x) + F.col("far")) / size).cast("int"))).alias(n) for x, n in (("gr", "br"), ("gc", "bc"))]
    near = starts.withColumn("far", far).select("gc", "far", ranges[0]).distinct().select("br", ranges[1]).distinct()
    gr, gc = (F.floor(F.col("tile") / across) * side + F.col("r")).cast("int"), (F.col("tile") % across * side + F.col("c")).cast("int")
    plain = cells.filter("h is not null").select(gr.alias("gr"), gc.alias("gc"), F.col("h").cast("double").alias("h"))
    keyed = plain.withColumns({"br": F.floor(F.col("gr") / size).cast("int"), "bc": F.floor(F.col("gc") / size).cast("int")}).join(near, ["br", "bc"], "left_semi")
    place = (F.pmod("gr", F.lit(size)) * size + F.pmod("gc", F.lit(size))).cast("int")
    listed = keyed.groupBy("br", "bc").agg(F.collect_list(place).alias("places"), F.collect_list("h").alias("heights"))  # a block is bounded

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places, heights in zip(b.column(2), b.column(3), strict=True):
                ground = np.full(size * size, np.inf)
                ground[places.values.to_numpy()] = heights.values.to_numpy()
                out.append(ground.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["br", "bc", "ground"])

    return listed.mapInArrow(packed, "br int, bc int, ground binary")


def _rims(solved: DataFrame, size: int) -> DataFrame:
    """What each solved block shows to each of its eight neighbours: (search_id, br, bc, from_r, from_c, rim); a rim may be empty."""

    def shown(dr: int, dc: int) -> Column:
        def at(cell: Column) -> Column:
            rows = F.lit(True) if not dr else F.pmod(cell["r"], F.lit(size)) == (size - 1 if dr > 0 else 0)
            cols = F.lit(True) if not dc else F.pmod(cell["c"], F.lit(size)) == (size - 1 if dc > 0 else 0)
            return rows & cols

        return F.struct((F.col("br") + dr).alias("br"), (F.col("bc") + dc).alias("bc"), F.filter("cells", at).alias("rim"))

    sent = solved.select("search_id", F.col("br").alias("from_r"), F.col("bc").alias("from_c"), F.explode(F.array(*(shown(dr, dc) for dr, dc in STEPS))).alias("to"))
    return sent.select("search_id", "to.br", "to.bc", "from_r", "from_c", "to.rim")


def reach(cells: DataFrame, starts: DataFrame, side: int, across: int, cell_m: float, block: int = BLOCK, **parameters: float) -> DataFrame:
    """(search_id, gr, gc, height, dist, ref_gr, ref_gc, near): every cell that each search reaches, with the length of the way and where its last leg began.

    ``cells`` has (tile, r, c, h), tiles numbered row by row with ``across`` to a row; gr and gc count over all tiles. ``starts`` has (search_id, gr, gc, height) and
    may have a column for each of ``DEFAULTS``, which else holds as given by ``parameters`` for all searches. ``near`` tells whether the way comes within ``margin`` of the
    ground anywhere from ``start_distance`` on. A start below ground, on a void or off the tiles reaches nothing; the start has no reference. Searches have different ids.
    """
    spark = cells.sparkSession
    given = DEFAULTS | parameters
    searches = starts.select(
        F.col("search_id").cast("long").alias("search_id"), F.col("gr").cast("int").alias("gr"), F.col("gc").cast("int").alias("gc"), F.col("height").cast("double").alias("height"),
        *((F.col(k) if k in starts.columns else F.lit(v)).cast("double").alias(k) for k, v in given.items()),
    )
    searches = written(searches.filter(F.col("height").isNotNull() & (F.col("gr") >= 0) & F.col("gc").between(0, across * side - 1)), "searches")
    with arrow_batches(spark, BATCH):
        blocks = written(_blocks(cells, searches, side, across, cell_m, block), "blocks")
    key, edge = ["search_id", "br", "bc"], ["search_id", "br", "bc", "from_r", "from_c"]
    rims = spark.createDataFrame([], f"search_id long, br int, bc int, from_r int, from_c int, rim {_CELLS}")
    touched = searches.select("search_id", F.floor(F.col("gr") / block).cast("int").alias("br"), F.floor(F.col("gc") / block).cast("int").alias("bc"))
    rounds: list[DataFrame] = []
    blocks, named = blocks.hint("merge"), searches.hint("merge")
    with arrow_batches(spark, BATCH), read_batches(spark, BATCH):
        while True:
            at = rims.hint("merge").join(touched, key, "left_semi").groupBy(key).agg(F.collect_list("rim").alias("rims")).hint("merge")  # eight at most
            asked = touched.join(named, "search_id").join(at, key, "left").join(blocks, ["br", "bc"])  # ground last: it is not moved with each search
            fresh = written(asked.mapInArrow(_solver(block, cell_m), f"search_id long, br int, bc int, cells {_CELLS}"), "solved")
            rounds.append(fresh.withColumn("round", F.lit(len(rounds))))
            before = rims.select(*edge, F.col("rim").alias("before")).hint("merge")
            new = ~F.col("rim").eqNullSafe(F.coalesce("before", F.array().cast(_CELLS)))
            shown = written(_rims(fresh, block).join(before, edge, "left").withColumn("new", new).drop("before"), "rims")
            if shown.filter("new").isEmpty():
                break
            touched = shown.filter("new").select(key).distinct()
            rims = written(rims.join(shown.select(edge).hint("merge"), edge, "left_anti").unionByName(shown.filter(F.size("rim") > 0).drop("new")), "rims")
        every = functools.reduce(DataFrame.unionByName, rounds)
        last = every.groupBy(key).agg(F.max("round").alias("round"))
        solved = every.join(last.hint("merge"), [*key, "round"], "left_semi")  # a block counts as it was solved last
        one = written(solved.select("search_id", F.explode("cells").alias("x")), "reach")
    return one.select("search_id", F.col("x.r").alias("gr"), F.col("x.c").alias("gc"), F.col("x.h").alias("height"), F.col("x.d").alias("dist"), F.col("x.pr").alias("ref_gr"), F.col("x.pc").alias("ref_gc"), F.col("x.near").alias("near"))
