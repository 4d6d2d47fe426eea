"""Goldens re-derived from the reference's own map data by reading (FIXTURES.md 2)."""

from tessera.operators import raster, sight
from tessera.params import ViewParams

# The reference map's 13 rectangles (x1, y1, x2, y2), inclusive,
# six rooms then seven corridors, on a 64 x 32 grid.
REFERENCE_RECTS = [
    (2, 2, 14, 10), (20, 2, 34, 9), (40, 3, 60, 12), (4, 14, 20, 28), (26, 16, 38, 28),
    (44, 16, 60, 28), (15, 6, 20, 7), (35, 6, 40, 7), (10, 11, 11, 14), (20, 21, 26, 22),
    (38, 22, 44, 23), (28, 9, 29, 16), (52, 12, 53, 16),
]


def reference_grid(spark):
    rects = raster.normalize_rects(spark.createDataFrame(REFERENCE_RECTS, "x1 int, y1 int, x2 int, y2 int"))
    floors = raster.rasterize_rects(rects)
    resp = raster.rect_centroids(raster.filter_rects(rects, 6, 6))
    return floors, resp, raster.classify_cells(raster.lattice(spark, 0, 63, 0, 31),
                                               [(resp, "R"), (floors, ".")])


def test_rasterized_cells(spark):
    floors, _, _ = reference_grid(spark)
    assert floors.count() == 1178
    assert floors.distinct().count() == 1156


def test_tile_counts_and_respawns(spark):
    _, resp, grid = reference_grid(spark)
    counts = dict(grid.groupBy("tile").count().collect())
    assert counts == {"#": 892, ".": 1150, "R": 6}
    cells = sorted((r.x, r.y) for r in grid.filter("tile = 'R'").collect())
    assert cells == sorted([(8, 6), (27, 5), (50, 7), (12, 21), (32, 22), (52, 22)])


def test_observer_at_4_4(spark):
    _, _, grid = reference_grid(spark)
    obs = spark.createDataFrame([(1, 4.0, 4.0, 0.0)], "id long, x double, y double, dir double")
    vis = sight.visible_cells(sight.ray_march(obs, grid, ViewParams()))
    assert vis.count() == 1562
    assert vis.select("tile_x", "tile_y").distinct().count() == 66
    assert vis.filter("tile = '#'").select("col").distinct().count() == 33


def test_ray_fan_is_inclusive(spark):
    obs = spark.createDataFrame([(1, 4.0, 4.0, 0.0)], "id long, x double, y double, dir double")
    rays = sight.ray_fan(obs, ViewParams())
    assert rays.count() == 129
    vp = ViewParams()
    a = dict((r.col, r.angle) for r in rays.collect())
    assert abs(a[0] - (-vp.fov / 2)) < 1e-12 and abs(a[127] - vp.fov / 2) < 1e-12


def test_glyph_cells_transparent_and_shape(spark):
    art = spark.createDataFrame([(0, [".@@.", "#..#"])], "id int, lines array<string>")
    cells = raster.glyph_cells(art, "id", "lines").collect()
    assert len(cells) == 8
    opaque = sorted((c.sx, c.sy, c.ch) for c in cells if c.ch is not None)
    assert opaque == [(0, 1, "#"), (1, 0, "@"), (2, 0, "@"), (3, 1, "#")]
