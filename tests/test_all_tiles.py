"""Queries that serve every tile and every zoom."""

from terrapath.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_tile_and_zoom_is_served(spark):
    run = {n: catalog.queries()[n](spark, SF) for n in ("grid_rasters", "kml_placemarks", "dem_point_lookup", "missing_tiles", "dem_stats")}
    tiles = {r["tile"] for r in run["dem_stats"].select("tile").distinct().collect()}
    for name in ("grid_rasters", "kml_placemarks"):
        assert {r["tile"] for r in run[name].select("tile").distinct().collect()} == tiles
    assert len({r["tile"] for r in run["dem_point_lookup"].collect()}) > 5
    assert {13, 15} <= {r["zoom"] for r in run["missing_tiles"].select("zoom").distinct().collect()}
