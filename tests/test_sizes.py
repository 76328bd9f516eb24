"""Steps whose plans must hold at any size: no cells sent to the driver, no limit on rows, parts that grow in number and not in size."""

import inspect
import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from terrapath.operators import paths, raster, reach, tiles
from terrapath.operators import requests as Q
from terrapath.plans import documents as document_plans
from terrapath.plans import inputs
from terrapath.plans import requests as plans
from terrapath.sources import documents

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_recursion_has_no_limit_of_rows(spark):
    tree = spark.range(1, 600).select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).cast("long").alias("parent"))
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000")
    try:
        got = paths.backtrace_sql(tree, tree.select("id")).groupBy("target").count().agg(F.sum("count")).first()[0]
    finally:
        spark.conf.set(name, before)
    assert got == sum(k.bit_length() for k in range(1, 600))


def test_cells_are_not_taken_for_few(spark):
    stats = inputs.dem(spark, SF)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cells = inputs.dem(spark, SF).count()
    assert int(str(stats)) >= 16 * cells


def test_parts_of_tiles_are_bounded(spark, tmp_path):
    spark.range(6000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    filled = raster.fill_voids(inputs.dem(spark, str(tmp_path)), ("tile",))
    most = filled.groupBy(F.spark_partition_id()).agg(F.countDistinct("tile").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * inputs.PART_TILES


def test_grids_move_no_row_per_cell(spark):
    """The cells of a grid come out of a join of tiles: what goes into it is a row per grid and tile."""
    metas = plans._grids(spark, SF)
    heights = Q.grid_heights(metas, raster.fill_voids(inputs.dem(spark, SF), ("tile",)), inputs.SIDE, plans.ACROSS)
    assert "Generate explode(sequence(0, (rows" not in _plan(heights)
    assert "strategy=merge" in _plan(heights)


def test_thinned_grids_take_the_nearest_lines(spark):
    """Every grid of any thinning against the lines of its definition, half of a cell rounded up."""
    side, across = 4, 3
    cells = spark.range(12).crossJoin(spark.range(side * side).withColumnRenamed("id", "i")).selectExpr("id AS tile", f"cast(i div {side} AS int) AS r", f"cast(i % {side} AS int) AS c", "cast(id * 100 + i AS int) AS h")
    shapes = [(k, rows, cols, r0, c0, n_r, n_c) for k, (rows, cols, r0, c0, n_r, n_c) in enumerate([(1, 1, 5, 6, 1, 1), (2, 3, 0, 0, 7, 5), (5, 4, 3, 2, 9, 10), (9, 10, 3, 2, 9, 10), (4, 1, 1, 1, 7, 3), (3, 6, 0, 1, 16, 11)])]
    metas = spark.createDataFrame(shapes, "request_id long, rows int, cols int, r0 int, c0 int, n_r int, n_c int")
    got = sorted(tuple(x) for x in Q.grid_heights(metas, cells, side, across).collect())

    def old(t, n_new, n_old):
        return int(t * ((n_old - 1) / max(n_new - 1, 1)) + 0.5)

    want = []
    for k, rows, cols, r0, c0, n_r, n_c in shapes:
        for r in range(rows):
            for c in range(cols):
                gr, gc = r0 + old(r, rows, n_r), c0 + old(c, cols, n_c)
                want.append((k, r, c, (gr // side * across + gc // side) * 100 + gr % side * side + gc % side))
    assert got == sorted(want)


def test_metadata_looks_up_the_middle_alone(spark):
    metas, cells = plans._grids(spark, SF), raster.fill_voids(inputs.dem(spark, SF), ("tile",))
    whole = Q.grid_metadata(metas, Q.grid_heights(metas, cells, inputs.SIDE, plans.ACROSS))
    middle = Q.middle_heights(metas, cells, inputs.SIDE, plans.ACROSS)
    assert middle.count() <= metas.count()
    assert sorted(map(tuple, Q.grid_metadata(metas, middle).collect())) == sorted(map(tuple, whole.collect()))


def test_margins_of_paths_from_their_legs(spark):
    tree = spark.range(1, 40).selectExpr("id", "CASE WHEN id > 1 THEN id div 2 END AS parent", "id * 31 % 97 AS dist", "cast(id * 7 % 11 AS int) AS r", "cast(id * 5 % 13 AS int) AS c", "cast(300 - id AS double) AS h")
    ground = spark.range(11 * 13).selectExpr("cast(id div 13 AS int) AS r", "cast(id % 13 AS int) AS c", "cast(id * 17 % 200 AS int) AS ground")
    path, of_legs = paths.backtrace(tree, tree.filter("id >= 20").select("id")), paths.series(paths.legs(tree), ground, 120.0, 10.0)
    whole = paths.margin_violations(paths.along(path, of_legs), 120.0, 10.0)
    found = paths.worst_of_legs(paths.along(path, paths.margin_violations(of_legs, 120.0, 10.0, "id")))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    assert any(r["first_in_margin"] is not None for r in found.collect())


def test_tiles_of_equal_windows_are_listed_once(spark):
    windows = inputs.windows(spark, SF)
    copies = windows.unionByName(windows.withColumn("box_id", F.col("box_id") + 100))
    zooms = F.array(F.lit(9), F.lit(12))
    ranges = tiles.tile_range(windows, zooms).select("zoom", "x0", "x1", "y0", "y1").distinct().count()
    assert tiles.tile_range(copies, zooms).select("zoom", "x0", "x1", "y0", "y1").distinct().count() == ranges
    want = tiles.coverage(copies, zooms).select("zoom", "x", "y").distinct()
    got = tiles.tiles(copies, zooms)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_of_equal_tiles_share_a_shape(spark):
    windows = inputs.windows(spark, SF)
    copies = windows.unionByName(windows.withColumn("box_id", F.col("box_id") + 100))
    got = {r["box_id"]: r["shape"] for r in tiles.shapes(copies, F.array(F.lit(9))).select("box_id", "shape").collect()}
    assert all(got[b + 100] == got[b] for b in got if b < 100) and len(got) == 2 * windows.count()


def test_ground_is_joined_last(spark):
    """In the join of a round of the reach, ground comes after the rims, so it is not moved once per search."""
    source = inspect.getsource(reach.reach)
    assert source.index(".join(at, key") < source.index(".join(blocks,")


def test_searches_broadcast_no_table_that_grows(spark, tmp_path, monkeypatch):
    """Files are no measure of the rows in them: ground, rims and searches of the rounds, and nodes that are looked up, meet by merge."""
    plans_of, real = {}, reach.written

    def recorded(df, name):
        plans_of.setdefault(name, []).append(_plan(df))
        return real(df, name)

    monkeypatch.setattr(reach, "written", recorded)
    asked, cells = plans._requests(spark, SF), raster.fill_voids(inputs.dem(spark, SF), ("tile",))
    Q.search_once(asked, cells, inputs.SIDE, plans.ACROSS, plans.CELL_M, str(tmp_path / "store"))
    assert all(p.count("strategy=merge") == p.count("Join ") for name in ("solved", "rims") for p in plans_of[name][1:]) and len(plans_of["solved"]) > 1
    assert "strategy=merge" in plans_of["reach"][0]
    _, boxes, nodes = Q._answers(asked, str(tmp_path / "store"))
    top = _plan(raster.lookup_cells(nodes.select("search_id", "gr", "gc"), cells, inputs.SIDE, plans.ACROSS)).split("Join ")[1].splitlines()[0]
    assert "rightHint=(strategy=merge)" in top, top
    assert "strategy=merge" in _plan(boxes)  # requests meet searches by their long keys


def test_paths_broadcast_no_nodes(spark, tmp_path, monkeypatch):
    """Nodes in a small file may be many: trees, jumps and legs meet by merge."""
    spark.range(1, 3000).selectExpr("id", "CASE WHEN id > 1 THEN id div 2 END AS parent", "id AS dist", "cast(id % 11 AS int) AS r", "cast(id % 13 AS int) AS c", "1.0D AS h").write.parquet(f"{tmp_path}/tree")
    tree, plans_of, real = spark.read.parquet(f"{tmp_path}/tree"), [], paths.written

    def recorded(df, name):
        plans_of.append(_plan(df))
        return real(df, name)

    monkeypatch.setattr(paths, "written", recorded)
    path = paths.backtrace(tree, tree.filter("id > 2000").select("id"))
    plans_of += [_plan(df) for df in (paths.legs(tree), paths.profile(path, tree), paths.along(path, paths.legs(tree)))]
    joins = [line for p in plans_of for line in p.splitlines() if "Join " in line]
    assert len(joins) > 10 and all("strategy=merge" in line for line in joins)
    assert path.count() == sum(k.bit_length() for k in range(2001, 3000))


def test_rasters_broadcast_no_nodes(spark, tmp_path):
    """The nodes of a store are looked up by merge, whatever the size of its files."""
    asked, cells = plans._requests(spark, SF), raster.fill_voids(inputs.dem(spark, SF), ("tile",))
    lookups = [line for line in _plan(Q.rasters(asked, cells, inputs.SIDE, plans.ACROSS, str(tmp_path / "none"))).splitlines() if "Join Inner" in line and "tile" in line]
    points = spark.range(3).selectExpr("id", "0 AS gr", "0 AS gc")
    lookups += [line for line in _plan(raster.lookup_cells(points, cells, inputs.SIDE, plans.ACROSS)).splitlines() if "Join Inner" in line and "tile" in line]
    assert lookups and all("strategy=merge" in line for line in lookups)


def test_rasters_move_no_row_per_cell(spark, tmp_path):
    """Requests, boxes and lines meet by merge, and the cells of a raster come out of the last join."""
    asked, cells = plans._requests(spark, SF), raster.fill_voids(inputs.dem(spark, SF), ("tile",))
    top = _plan(Q.rasters(asked, cells, inputs.SIDE, plans.ACROSS, str(tmp_path / "none")))
    joins = [line for line in top.splitlines() if "Join Inner" in line and "tile" not in line or "Join LeftOuter" in line]
    assert len(joins) > 2 and all("strategy=merge" in line for line in joins), joins
    below = top[top.index("Join LeftOuter") :]
    assert "explode(sequence(min_gr" in below and "explode(sequence(min_gc" not in below


def test_rasters_fill_whole_lines(spark, tmp_path):
    """Two requests of one search whose nodes leave out cells and a whole line, and a request of another search, against their definition."""
    side, across, store = 4, 3, str(tmp_path / "store")
    cells = spark.range(9).crossJoin(spark.range(side * side).withColumnRenamed("id", "i")).selectExpr("id AS tile", f"cast(i div {side} AS int) AS r", f"cast(i % {side} AS int) AS c", "cast(id * 100 + i AS int) AS h")
    asked = spark.createDataFrame([(1, 5, 5, 10.0), (2, 5, 5, 10.0), (3, 2, 2, 20.0), (4, 2, 2, 30.0)], "request_id long, gr int, gc int, start_height double")
    keys = {r["request_id"]: r["key"] for r in Q.parameters(asked).collect()}
    spark.createDataFrame([(keys[k], "b", s, gr, gc, 0.0, 0.0) for k, s, gr, gc in ((1, 7, 5, 5), (3, 8, 2, 2), (4, 9, 2, 2))], Q._SEARCHES).write.parquet(f"{store}/searches")
    nodes = {7: {(3, 2): True, (3, 9): False, (5, 5): True, (6, 3): False}, 8: {(0, 11): True}}  # search 9 reaches nothing
    spark.createDataFrame([(s, r, c, 1000.5 + r, 0.0, None, None, near) for s, at in nodes.items() for (r, c), near in at.items()], Q._NODES).write.parquet(f"{store}/nodes/batch=b")
    want = []
    for request, s in ((1, 7), (2, 7), (3, 8)):
        rows, cols = zip(*nodes[s], strict=True)
        for r in range(min(rows), max(rows) + 1):
            for c in range(min(cols), max(cols) + 1):
                ground = (r // side * across + c // side) * 100 + r % side * side + c % side
                known = (1000.5 + r, 1000.5 + r - ground, nodes[s][r, c]) if (r, c) in nodes[s] else (-1000.0, -1000.0, False)
                want.append((request, r - min(rows), c - min(cols), *known))
    got = sorted(map(tuple, Q.rasters(asked, cells, side, across, store).collect()))
    assert got == sorted(want)


def test_cones_make_each_text_once(spark, tmp_path):
    """Requests alike share the nodes and the texts of their search, texts are made before they meet requests, and what grows meets by merge."""
    asked, cells, store = plans._requests(spark, SF), raster.fill_voids(inputs.dem(spark, SF), ("tile",)), str(tmp_path / "store")
    searches = Q.search_once(asked, cells, inputs.SIDE, plans.ACROSS, plans.CELL_M, store)
    assert searches < asked.count()
    metas, nodes = Q.cones(asked, cells, inputs.SIDE, plans.ACROSS, plans.CELL_M, plans.CORNER, plans.DEGREES, store)
    assert nodes.count() == Q.stored_nodes(spark, store).count()
    pieces = documents.cone_pieces(metas, nodes)
    top = _plan(pieces)
    joins = [line for line in top.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins) and "collect_list" not in top
    texts = pieces.filter("piece between 0 and 2147483646")
    assert texts.select("text").distinct().count() < texts.count() and texts.select("request_id").distinct().count() == metas.count()


def test_cells_are_looked_up_by_runs(spark):
    """Sides that are no multiple of a run, cells that lack and cells without height, against a plain look; a run of cells is moved as one row."""
    side, across = raster.RUN + 5, 2
    ground = {(tile, r, c): None if (r + c) % 7 == 0 else tile * 1000 + r * side + c for tile in range(4) for r in (0, 1, side - 1) for c in range(side) if (r * 3 + c) % 5}
    cells = spark.createDataFrame([(*at, h) for at, h in ground.items()], "tile long, r int, c long, h int")
    points = [(k, r, c) for k, (r, c) in enumerate((r, c) for r in (-1, 0, 1, 2, side - 1, side, side + 1, 2 * side) for c in range(2 * side))]
    got = raster.lookup_cells(spark.createDataFrame(points, "id long, gr int, gc int"), cells, side, across)
    at = {k: (r // side * across + c // side, r % side, c % side) for k, r, c in points}
    want = [(k, r, c, ground[at[k]]) for k, r, c in points if at[k] in ground]
    assert got.columns == ["id", "gr", "gc", "ground"] and sorted(map(tuple, got.collect()), key=lambda x: x[0]) == want and None in {x[3] for x in want}
    assert got.filter("ground is null").count() == sum(x[3] is None for x in want)
    below = _plan(got).split("Join ")[1]
    assert "collect_list" in below


def test_rounds_read_few_blocks_at_once(spark, monkeypatch):
    """A row of a round's tables holds up to a block of cells: a reader that takes 4,096 of them fills an executor."""
    name, seen, real = "spark.sql.parquet.columnarReaderBatchSize", {}, reach.written
    before = spark.conf.get(name)

    def recorded(df, table):
        seen.setdefault(table, set()).add(int(spark.conf.get(name)))
        return real(df, table)

    monkeypatch.setattr(reach, "written", recorded)
    starts = spark.createDataFrame([(1, 8, 8, 2000.0)], "search_id long, gr int, gc int, height double")
    assert reach.reach(raster.fill_voids(inputs.dem(spark, SF), ("tile",)), starts, inputs.SIDE, plans.ACROSS, plans.CELL_M, 16).count() > 0
    assert all(max(seen[x]) <= reach.BATCH for x in ("solved", "rims", "reach")) and spark.conf.get(name) == before


def test_groups_of_texts_are_bounded(spark, monkeypatch):
    """A reader takes up to 4,096 rows of a group of rows at once; texts come in groups of bounded bytes."""
    paths_of, real = [], documents.written

    def recorded(df, *args):
        out = real(df, *args)
        paths_of.append(out.inputFiles())
        return out

    monkeypatch.setattr(documents, "written", recorded)
    monkeypatch.setattr(documents, "GROUP_BYTES", 200_000)
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.sha2(F.concat_ws("-", F.col("id").cast("string"), k.cast("string")), 256)), "")
    items = spark.range(0, 900, 1, 1).select(F.lit(1).cast("long").alias("key"), F.col("id").cast("int").alias("piece"), F.lit(0).alias("pos"), F.concat(F.lit('"'), letters, F.lit('"')).alias("item"))
    metas = spark.createDataFrame([(1, "a")], "key long, name string")
    assert documents.in_pieces(metas, items, "key", "xs").count() == 902
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in paths_of[1]]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 900 and max(g.total_byte_size for g in groups) < 2_000_000 < sum(g.total_byte_size for g in groups)


def test_documents_of_large_mosaics(spark, tmp_path):
    """The mosaic grows with the keys: tiles of suppliers from some 83,000 on, and requests of three times as many, lie beyond 999 degrees."""
    keys = [(k,) for k in (*range(100_000, 100_010), *range(300_000, 300_006))]
    spark.createDataFrame(keys, "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    south = {}
    for query in (document_plans.cone_documents, document_plans.height_map_documents):
        texts = {}
        for request, piece, text in sorted(map(tuple, query(spark, str(tmp_path)).select("request_id", "piece", "text").collect())):
            texts[request] = texts.get(request, "") + text
        south[query.__name__] = {k: json.loads(text)["lat"][0] for k, text in texts.items()}
    asked = plans._requests(spark, str(tmp_path)).filter("request_id >= 300000")
    reached = {r["request_id"]: r["gr"] for r in asked.collect()}
    cones, maps = south["cone_documents"], south["height_map_documents"]
    assert set(cones) == set(reached) and all(1000 < cones[k] <= 43 + reached[k] * 0.0018 + 1e-6 for k in cones)
    assert set(maps) == {k for (k,) in keys} and all(1000 < x for x in maps.values())
