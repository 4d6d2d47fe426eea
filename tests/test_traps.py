"""One small case per semantic trap we act on and the hand-made edge
cases of FIXTURES 5."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions.num import cell, explode_range, idiv, q6
from tessera.operators import camera, raster, report, sight, spatial, state
from tessera.params import StateParams, ViewParams
from tessera.streaming import jobs

TS = dt.datetime(2024, 1, 1, 0, 0, 0)


def grid3(spark):
    """3 x 3 grid: wall in the centre, respawn at (0, 0)."""
    rows = [(x, y, "#" if (x, y) == (1, 1) else ("R" if (x, y) == (0, 0) else "."))
            for x in range(3) for y in range(3)]
    return spark.createDataFrame(rows, "x int, y int, tile string")


def test_t1_cell_rounds_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (0.49,), (-0.4,)], "v double")
    assert [r.c for r in df.select(cell("v").alias("c")).collect()] == [2, 4, -2, 0, 0]


def test_t1b_floor_binning_differs(spark):
    from tessera.functions.num import floor_cell
    df = spark.createDataFrame([(2.7,)], "v double")
    r = df.select(cell("v").alias("a"), floor_cell("v").alias("b")).first()
    assert (r.a, r.b) == (3, 2)


def test_t2_integer_division_truncates(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2), (64, 2)], "a int, b int")
    assert [r.q for r in df.select(idiv("a", "b").alias("q")).collect()] == [-3, 3, 32]


def test_t3_q6_is_floor_half_up(spark):
    df = spark.createDataFrame([(0.1234565,), (-1.0000004,)], "v double")
    vals = [r.q for r in df.select(q6("v").alias("q")).collect()]
    assert abs(vals[0] - 0.123457) < 1e-12 and abs(vals[1] - (-1.0)) < 1e-12


def test_t5_empty_and_reversed_series(spark):
    df = spark.createDataFrame([(3, 1), (1, 0), (1, 2), (5, 5)], "lo int, hi int")
    out = df.select("lo", explode_range("lo", "hi").alias("v")).collect()
    assert sorted((r.lo, r.v) for r in out) == [(1, 1), (1, 2), (5, 5)]


def test_t5_reversed_rect_rasterizes_after_normalize(spark):
    rect = spark.createDataFrame([(3, 3, 1, 1), (2, 2, 2, 2)], "x1 int, y1 int, x2 int, y2 int")
    assert raster.rasterize_rects(rect).count() == 1
    assert raster.rasterize_rects(raster.normalize_rects(rect)).count() == 10


def test_t5_offscreen_spans_are_empty(spark):
    spans = spark.createDataFrame(
        [(1, 1, 0, 0, "@", 1.0, 0, -5, 3, 4), (1, 1, 0, 0, "@", 1.0, 200, 127, 3, 4),
         (1, 1, 0, 0, "@", 1.0, 2, 2, 60, 63)],
        "obs_id long, target_id long, sx int, sy int, ch string, depth double, x0 int, x1 int, y0 int, y1 int")
    # clamped spans: the first ended left of the screen (x0 = 0 > x1 = -5), the second
    # starts right of it (x0 = 200 > x1 = 127); neither may produce a pixel
    assert camera.span_pixels(spans).count() == 4


def test_t10_nearest_pixel_ties_by_target_then_texel(spark):
    px = spark.createDataFrame(
        [(1, 7, 2, 2, 0, 0, "a", 1.0), (1, 5, 2, 2, 1, 0, "b", 1.0), (1, 5, 2, 2, 0, 0, "c", 1.0),
         (1, 9, 2, 2, 0, 0, "d", 2.0)],
        "obs_id long, target_id long, px int, py int, sx int, sy int, ch string, depth double")
    r = camera.nearest_pixel(px).first()
    assert (r.ch, r.target_id) == ("c", 5)


def small_world(spark, tiles, vp=ViewParams()):
    """A packed grid of 128 x 128 floor cells with the given walls and one respawn cell."""
    rows = spark.range(128).select(F.col("id").alias("y"))
    floor = raster.band_lattice(rows, 128).join(
        spark.createDataFrame(tiles or [(-1, -1)], "x long, y long"), ["x", "y"], "left_anti")
    resp = spark.createDataFrame([(0, 0)], "x long, y long")
    return raster.PackedGrid.from_layers([(resp, "R"), (floor, ".")], 128, rows)


def test_t11_two_mobs_in_one_cell_show_one_icon(spark):
    grid = small_world(spark, [(30, 25), (20, 31)])
    obs = spark.createDataFrame([(1, 25.2, 25.2, 0.0)], "id long, x double, y double, dir double")
    mobs = spark.createDataFrame([(28.1, 25.2, "b"), (28.6, 25.9, "a"), (22.0, 25.0, "z"), (27.0, 25.0, None)],
                                 "x double, y double, icon string")
    vp = ViewParams()
    got = {(r.x, r.y): r.ch for r in camera.coverage_map(camera.coverage(obs, grid, mobs, vp), vp).collect()}
    assert len(got) == (2 * vp.reach + 1) ** 2
    assert got[(28, 25)] == "a"          # smallest icon, only one row for the cell
    assert got[(27, 25)] == "?"          # a mob without icon
    assert got[(30, 25)] == "#"          # seen wall
    assert got[(20, 31)] == "#"          # remembered wall
    assert got[(22, 25)] == " "          # behind the observer: the mob is not seen
    assert got[(29, 25)] == "."          # seen floor


def test_observer_off_the_grid_and_in_a_wall(spark):
    """Off the grid no cell is seen and nothing hits; inside a wall every ray hits at once."""
    grid = small_world(spark, [(40, 40)])
    obs = spark.createDataFrame([(1, -30.0, 5.0, 3.1), (2, 40.0, 40.0, 0.0), (3, 64.0, 64.0, 0.0)],
                                "id long, x double, y double, dir double")
    rays = sight.ray_summary(obs, grid)
    assert rays.filter("id = 1").filter("n is not null or extent is not null").count() == 0
    assert rays.filter("id = 2 and n = 1 and dist = 0").count() == 129
    assert rays.filter("id = 3 and n is null").count() == 129        # nothing within reach
    assert rays.count() == 3 * 129
    assert camera.observer_view(obs, grid).select("id", F.size("cols").alias("n")).filter("n = 129").count() == 3
    target = spark.createDataFrame([(9, "player", -35.0, 5.0, 1.0, 1.0, 0, "T"), (8, "player", -50.0, 5.0, 1.0, 1.0, 0, "T")],
                                   "id long, kind string, x double, y double, world_w double, world_h double, stamp_id int, icon string")
    px = spark.createDataFrame([(1, 9, 64, 32, 0, 0, "@", 5.0), (1, 8, 64, 32, 0, 0, "@", 20.0)],
                               "obs_id long, target_id long, px int, py int, sx int, sy int, ch string, depth double")
    assert [r.target_id for r in camera.occlude(px, sight.ray_extent(rays)).collect()] == [9]
    assert {r.target_id for r in camera.observer_frame(obs, target).collect()} == {9}


def test_t4_without_the_inclusive_edge(spark):
    vp = ViewParams(inclusive_edge=False)
    grid = small_world(spark, [])
    obs = spark.createDataFrame([(1, 25.0, 25.0, 0.0)], "id long, x double, y double, dir double")
    assert sight.ray_fan(obs, vp).count() == 128
    view = camera.observer_view(obs, grid, vp).withColumn("top", F.array().cast("array<struct<px:int,py:int,ch:string,depth:double>>"))
    rows = view.select(camera.view_rows(vp).alias("r")).first().r
    assert len(rows) == 64 and {len(r) for r in rows} == {128}


def test_t5_spans_clamp_at_the_four_edges(spark):
    e = spark.createDataFrame([(1, 1, "@", 1.0, -3, 32, 0, 0, 4, 4, 3.0, 3.0), (1, 2, "@", 1.0, 130, 32, 3, 0, 4, 4, 3.0, 3.0),
                               (1, 3, "@", 1.0, 64, -3, 0, 0, 4, 4, 3.0, 3.0), (1, 4, "@", 1.0, 64, 70, 0, 3, 4, 4, 3.0, 3.0),
                               (1, 5, "@", 1.0, 64, 32, 1, 1, 4, 4, 0.1, 0.1)],
                              "obs_id long, target_id long, ch string, depth double, screen_x int, screen_y int, sx int, sy int, "
                              "w int, h int, scale_x double, scale_y double")
    out = {r.target_id: (r.x0, r.x1, r.y0, r.y1) for r in camera.stamp_spans(e).collect()}
    assert out[1][:2] == (0, -7)              # left of the screen: empty
    assert out[2][:2] == (133, 127)           # right of it: empty
    assert out[3][2:] == (0, -7)              # above: empty
    assert out[4][2:] == (73, 63)             # below: empty
    assert out[5] == (64, 64, 32, 32)         # smaller than a pixel: one pixel wide


def test_t12_out_of_bounds_precedence(spark):
    grid = grid3(spark)
    pts = spark.createDataFrame([(1, "player", -1.0, 0.5), (2, "bullet", 0.5, 5.0), (3, "player", 0.5, 5.0)],
                                "id int, kind string, x double, y double")
    intent = {r.id for r in spatial.out_of_bounds(pts, grid, "kind", "bullet").collect()}
    written = {r.id for r in spatial.out_of_bounds(pts, grid, "kind", "bullet", as_written=True).collect()}
    assert intent == {2} and written == {1, 2}


def test_t14_refill_clock(spark):
    a = spark.createDataFrame(
        [(1, 3, 1000), (2, 10, 0), (3, 0, 2000), (4, 9, 0)],
        "id long, ammo int, last_refill long")
    out = {r.id: (r.ammo, r.last_refill) for r in state.refill(a, 1500.5, 100, 10).collect()}
    assert out[1] == (8, 1501)        # 5 steps, last rounds half up
    assert out[2] == (10, 0)          # full: clock does not move
    assert out[3] == (0, 2000)        # now before last: no effect
    assert out[4] == (10, 1501)       # clamped to max


def _actors(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, dir double, hp int, ammo int, score int")


def test_t16_hit_applies_once_and_credit_once(spark):
    actors = _actors(spark, [(1, 0.0, 0.0, 0.0, 40, 1, 0), (2, 2.0, 2.0, 0.0, 100, 1, 0),
                             (3, 5.0, 5.0, 0.0, 100, 1, 0), (4, 6.0, 6.0, 0.0, 100, 1, 0)])
    proj = spark.createDataFrame(
        [(10, 3, 0.1, 0.1), (11, 3, -0.2, 0.3), (12, 4, 0.0, 0.0), (13, 3, 2.0, 2.0),
         (14, None, 0.0, 0.0), (15, 1, 0.0, 0.0)],
        "pid long, owner long, x double, y double")
    coll = spatial.cell_join(proj, actors)
    assert {r.pid for r in coll.collect()} == {10, 11, 12, 13}   # NULL owner and own actor drop out
    out = state.apply_hits(actors, state.cell_hits(actors, proj, 50), 50).collect()
    assert {r.id: r.hp for r in out} == {1: -10, 2: 50, 3: 100, 4: 100}
    assert {r.id: r.score for r in out} == {1: 0, 2: 0, 3: 1, 4: 1}    # two owners, one victim
    assert {r.pid for r in state.expire_hits(proj, actors).collect()} == {14, 15}


def test_a_projectile_spawned_in_this_tick_hits(spark):
    """It is inserted before all projectiles move, so it flies, hits and goes with the rest."""
    actors = _actors(spark, [(1, 5.0, 5.0, 0.0, 100, 3, 0), (2, 5.6, 5.0, 0.0, 50, 0, 0)])
    latest = spark.createDataFrame([(1, "x"), (2, "x")], "key long, action string")
    new = state.assign_ids(state.spawn(actors, latest).select("owner", "x", "y", "dir"), ["owner"], F.lit(2))
    assert [(r.owner, r.id) for r in new.collect()] == [(1, 3)]         # the second has no ammo
    moved = state.advance(new, 0.5)
    out = {r.id: (r.hp, r.score) for r in state.apply_hits(actors, state.cell_hits(actors, moved, 50), 50).collect()}
    assert out == {1: (100, 1), 2: (0, 0)}
    assert state.expire_hits(moved, actors).count() == 0


def test_get_or_create_makes_whole_rows(spark):
    have = spark.createDataFrame([(7, "a", 1.0, 2.0, 0.5, "player", 0, "A", 30, 2, 9), (4, "a", 3.0, 4.0, 0.0, "player", 0, "B", 80, 1, 0)],
                                 "id long, name string, x double, y double, dir double, kind string, stamp_id int, icon string, hp int, ammo int, score int")
    names = spark.createDataFrame([("a", "Z"), ("new", "Y"), ("new", "X"), ("new", "X")], "name string, icon string")
    out = {r.name: tuple(r)[1:] for r in state.get_or_create(have, names).collect()}
    assert out == {"a": (4, False, 3.0, 4.0, 0.0, "player", 0, "B", 80, 1, 0),
                   "new": (8, True, 4.0, 4.0, 0.0, "player", 0, "X", 100, 10, 0)}


def test_t17_one_respawn_cell_per_batch(spark):
    grid = spark.createDataFrame([(0, 0, "R"), (5, 5, "R"), (9, 1, "R"), (1, 1, ".")],
                                 "x int, y int, tile string")
    actors = _actors(spark, [(1, 3.0, 3.0, 1.0, 0, 0, 0), (2, 4.0, 4.0, 1.0, -20, 0, 0),
                             (3, 1.0, 1.0, 1.0, 5, 0, 0)])
    out = {r.id: (r.x, r.y, r.dir) for r in state.respawn(actors, grid, 17).collect()}
    keyed = min(((x * 7919 + y * 6101 + 17) % 10007, x, y) for x, y in [(0, 0), (5, 5), (9, 1)])
    assert out[1] == out[2] == (float(keyed[1]), float(keyed[2]), 0.0)
    assert out[3] == (1.0, 1.0, 1.0)


def test_moves_rejected_into_wall_or_off_grid(spark):
    grid = grid3(spark)
    actors = _actors(spark, [(1, 0.9, 1.0, 0.0, 100, 1, 0), (2, 2.3, 2.0, 0.0, 100, 1, 0),
                             (3, 0.0, 2.0, 0.0, 100, 1, 0)])
    latest = spark.createDataFrame([(1, "w"), (2, "w"), (3, "s")], "key long, action string")
    out = {r.id: (round(r.x, 6), r.y) for r in state.moves(actors, latest, grid).collect()}
    assert out[1] == (0.9, 1.0)       # 1.2 lands in the wall at (1, 1): rejected
    assert out[2] == (2.3, 2.0)       # 2.6 rounds to cell 3, off the grid: rejected
    assert out[3] == (-0.3, 2.0)      # -0.3 rounds to cell 0, a floor: accepted


def test_latest_action_tie_by_seq(spark):
    acts = spark.createDataFrame([(1, TS, 5, "w"), (1, TS, 7, "a"), (2, TS, 1, "x")],
                                 "key long, ts timestamp_ntz, seq long, action string")
    out = {r.key: r.action for r in state.latest_action(acts).collect()}
    assert out == {1: "a", 2: "x"}


def test_held_action_tolerance_boundary(spark):
    us0 = 1_704_067_200_000_000
    acts = spark.createDataFrame([(1, TS, 1, "w")], "key long, ts timestamp_ntz, seq long, action string")
    ticks = spark.createDataFrame([(1, 1, us0), (2, 1, us0 + 100_000), (3, 1, us0 + 100_001),
                                   (4, 1, us0 - 1), (5, 2, us0)], "tick_id long, key long, tick_us long")
    out = {r.tick_id: r.action for r in jobs.held_action(ticks, acts).collect()}
    assert out == {1: "w", 2: "w", 3: None, 4: None, 5: None}


def test_token_bucket_quota_at_zero_and_max(spark):
    t = [TS + dt.timedelta(seconds=s) for s in (0, 1, 2, 3, 3700, 3701, 3702)]
    acts = spark.createDataFrame([(1, ts, i, "x") for i, ts in enumerate(t)],
                                 "key long, ts timestamp_ntz, seq long, action string")
    out = [(r.allowed, r.tokens) for r in state.token_bucket(acts, 3, 3600).orderBy("seq").collect()]
    # 3 shots drain the bucket, the 4th is refused; after an hour the spend at 3700
    # leaves 0 and the refill adds one whole interval; then one more shot succeeds.
    assert out == [(1, 2), (1, 1), (1, 0), (0, 0), (0, 1), (1, 0), (0, 0)]


def test_trajectory_key_without_actor_starts_at_spawn(spark):
    sp = StateParams()
    starts = _actors(spark, [(1, 10.0, 10.0, 0.0, 100, 1, 0)]).select("id", "x", "y", "dir")
    acts = spark.createDataFrame([(1, TS, 1, "d"), (1, TS + dt.timedelta(seconds=1), 2, "w"),
                                  (9, TS, 3, "w")], "key long, ts timestamp_ntz, seq long, action string")
    out = {(r.key, r.seq): (r.x, r.y, r.dir) for r in state.trajectory(starts, acts, sp).collect()}
    import math
    x, y, d = out[(1, 2)]
    assert abs(d - 0.2) < 1e-12 and abs(x - (10 + math.cos(0.2) * 0.3)) < 1e-8
    assert abs(out[(9, 3)][0] - 4.3) < 1e-8                   # default start (4, 4, 0)


def test_column_height_and_bands(spark):
    vp = ViewParams()
    d = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0, 0.0, 2.0), (1, 2, 0.0, 0.0, 10.0)],
                              "id long, col int, angle double, dir double, depth double")
    h = {r.col: r.height for r in camera.column_height(d, vp).collect()}
    assert h == {0: 64, 1: 32, 2: 6}
    px = camera.column_raster(camera.column_height(d, vp), vp)
    assert px.count() == 3 * 65
    col1 = {r.y: r.ch for r in px.filter("x = 1").collect()}
    assert col1[15] == " " and col1[16] == "█" and col1[47] == "█" and col1[48] == "."


def test_panels(spark):
    """T18: a row wider than its frame is cut, a shorter one padded; T19: the footer is one
    line below the last row; a panel that has ended is blank."""
    df = spark.createDataFrame([(1, ["abc", "d"], ["x"], ["hello"]), (2, [], ["x", "y", "z"], [])],
                               "id long, a array<string>, b array<string>, c array<string>")
    a, b = report.framed(F.col("a"), 2), report.framed(F.col("b"), 1)
    rows = [(r.id, r.y, r.line) for r in report.lines(df, report.panel_zip(a, 2, b, 1, F.col("c"), gap="|")).collect()]
    assert rows[:4] == [(1, -1, "╔══╗|╔═╗|"), (1, 0, "║ab║|║x║|hello"), (1, 1, "║d ║|╚═╝|"), (1, 2, "╚══╝|   |")]
    assert rows[4:] == [(2, -1, "╔══╗|╔═╗|"), (2, 0, "╚══╝|║x║|"), (2, 1, "    |║y║|"), (2, 2, "    |║z║|"), (2, 3, "    |╚═╝|")]


def test_t9_null_name_makes_the_line_null(spark):
    a = spark.createDataFrame([(1, None, "A", 10, 2, 0), (2, "n", None, 10, 2, 0), (3, "n", "A", -5, None, 0)],
                              "id long, name string, icon string, hp int, ammo int, score int")
    out = {r.id: r.line for r in a.select("id", report.status_line().alias("line")).collect()}
    assert out[1] is None and out[2] is None and out[3].endswith("] 0   AMMO: ")


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace
    from tessera import session
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d))
    import pytest
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
    sc.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.scratch_path(fake, "x")
