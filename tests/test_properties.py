"""Properties over the sf0.001 fixture world and equivalence of the scalable helpers
with the plain single-window forms (on a deliberately skewed key)."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.num import q6
from tessera.functions.ranking import bucket_count, number_rows, number_rows_once, prefix_sums, sums_before_once
from tessera.operators import camera, sight, spatial
from tessera.params import ViewParams
from tessera.sources.world import LOD, World

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def world(spark):
    return World(spark, SF_SMALL)


def test_march_never_passes_a_wall(world, spark):
    m = sight.ray_march(world.actors(), world.grid(), world.vp)
    bad = (m.filter(F.col("tile") == "#").groupBy("id", "col").agg(F.min("n").alias("h"))
           .join(m, ["id", "col"]).filter(F.col("n") > F.col("h")))
    assert bad.count() == 0


def test_visible_cells_are_grid_cells(world):
    vis = sight.visible_cells(sight.ray_march(world.actors(), world.grid(), world.vp))
    g = world.grid().select(F.col("x").alias("tile_x"), F.col("y").alias("tile_y"), "tile")
    assert vis.join(g, ["tile_x", "tile_y", "tile"], "left_anti").count() == 0


def _same_rows(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_packed_march_equals_the_march_over_the_long_grid(world):
    long = sight.ray_march(world.actors(), world.grid(), world.vp)
    assert _same_rows(long, sight.ray_march(world.actors(), world.packed(), world.vp))


def test_entry_rows_give_the_visible_cells_of_the_full_march(world):
    """The fast path (entry rows only, no aggregate) equals the definition
    (every march row, grouped per cell) on the whole fixture world."""
    full = sight.visible_cells(sight.ray_march(world.actors(), world.grid(), world.vp))
    fast = sight.visible_entries(world.actors(), world.packed(), world.vp)
    assert _same_rows(full, fast)
    rays = sight.ray_summary(world.actors(), world.packed(), world.vp, places=True)
    r = world.vp.reach
    code = F.when(F.col("tile") == "#", sight.BLOCKED).when(F.col("tile") == "R", sight.MARKED).otherwise(sight.OPEN)
    place = (((F.col("tile_y") - F.floor("y") + r) * (2 * r + 1) + F.col("tile_x") - F.floor("x") + r) * 4 + code).cast("int")
    want = full.join(world.actors().select("id", "x", "y"), "id").select("id", "col", place.alias("p"))
    assert _same_rows(rays.select("id", "col", F.explode("places").alias("p")), want)
    extent = full.groupBy("id", "col").agg(F.max("dist").alias("extent"))
    assert _same_rows(extent, sight.ray_extent(rays))


def test_first_hit_is_the_wall_row_of_the_full_march(world):
    m = sight.ray_march(world.actors(), world.grid(), world.vp)
    walls = m.filter(F.col("tile") == "#").select("id", "col", "n", "dist")
    assert _same_rows(walls, sight.first_hit(world.actors(), world.packed(), world.vp))
    rays = sight.ray_summary(world.actors(), world.packed(), world.vp)
    assert _same_rows(walls, rays.filter("n is not null").select("id", "col", "n", "dist"))


def test_first_hit_exchanges_observers_only(world):
    """One exchange by id, below the fan-out; no step or cell row is shuffled."""
    plan = sight.first_hit(world.actors(), world.packed(), world.vp)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(id#") == 1
    assert not any("hashpartitioning" in line and "col#" in line for line in plan.splitlines())


def test_view_rows_equal_overlay_by_pixels(spark):
    """Rows built on the observer's own row equal the definition: base pixels with the
    nearest of the pixels left after occlusion laid over them."""
    from tessera.plans.catalog import _Camera
    cam = _Camera(spark, SF_SMALL)
    want = cam.c.raster_rows(cam.c.overlay(cam.base(), cam.nearest()))
    assert _same_rows(want, cam.rows())


def test_seen_cells_lie_in_the_coverage_window(world):
    seen = sight.visible_cell_set(world.actors(), world.packed(), world.vp)
    want = sight.visible_entries(world.actors(), world.packed(), world.vp).select("id", "tile_x", "tile_y", "tile").distinct()
    assert _same_rows(seen, want)
    far = F.greatest(F.abs(F.col("tile_x") - F.floor("x")), F.abs(F.col("tile_y") - F.floor("y")))
    assert seen.join(world.actors().select("id", "x", "y"), "id").filter(far > world.vp.reach).count() == 0


def test_blocked_plus_unblocked_is_input(world):
    p = world.projectiles()
    assert (spatial.blocked(p, world.grid()).count() + spatial.unblocked(p, world.grid()).count()
            == p.count())


def test_normalize_is_idempotent(world):
    from tessera.operators import raster
    once = raster.normalize_rects(world.rects())
    assert once.exceptAll(raster.normalize_rects(once)).count() == 0


def test_grid_has_one_row_per_cell(world):
    g = world.grid()
    assert g.count() == world.lattice().count() == g.select("x", "y").distinct().count()


@pytest.mark.parametrize("vp,width", [(ViewParams(), None), (ViewParams(step=0.2), 4.0), (ViewParams(fov=2.2), 2.0)])
def test_bounded_frame_gives_the_pixels_of_all_pairs(world, vp, width):
    """After occlusion the range-bounded frame draws what the cross join draws, also with
    longer rays, a wider view, and wider targets."""
    targets = world.targets()
    if width:
        targets = targets.withColumn("world_w", F.lit(width))
    extent = sight.ray_extent(sight.ray_summary(world.actors(), world.packed(), vp))

    def drawn(frame):
        lod = camera.choose_lod(camera.project(frame, vp), LOD)
        spans = camera.stamp_spans(camera.stamp_expand(lod, world.stamps(), world.stamp_pixels(), vp), vp)
        return camera.occlude(camera.span_pixels(spans), extent, vp)
    a, t = world.actors().alias("a"), targets.alias("t")
    dx, dy, turn = F.col("t.x") - F.col("a.x"), F.col("t.y") - F.col("a.y"), -F.col("a.dir")
    every = a.crossJoin(t).select(
        F.col("a.id").alias("obs_id"), F.col("t.id").alias("target_id"), "t.kind", "t.world_w", "t.world_h", "t.stamp_id", "t.icon",
        (dx * F.cos(turn) - dy * F.sin(turn)).alias("depth"), (dx * F.sin(turn) + dy * F.cos(turn)).alias("horiz"))
    assert _same_rows(drawn(camera.observer_frame(world.actors(), targets, vp)), drawn(every))


def _skewed(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(0, base + dt.timedelta(minutes=7 * i), i, (i * 37) % 5 - 2) for i in range(600)]
    rows += [(k, base + dt.timedelta(minutes=k * 13 + i), 1000 + k * 10 + i, (k + i) % 3 - 1)
             for k in range(1, 20) for i in range(5)]
    return spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, v long")


def test_prefix_sums_equal_running_window(spark):
    df = _skewed(spark)
    got = prefix_sums(df, "key", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000),
                      ["ts", "seq"], {"s": F.col("v")})
    w = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("v").over(w))
    assert got.select("key", "seq", "s").exceptAll(want.select("key", "seq", "s")).count() == 0
    assert got.count() == want.count()


def test_number_rows_equals_row_number(spark):
    df = _skewed(spark)
    got = number_rows(df, ["seq"], group=["key"])
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("seq")))
    assert got.select("key", "seq", "rn").exceptAll(want.select("key", "seq", "rn")).count() == 0
    glob = number_rows(df, ["key", "seq"]).agg(F.min("rn"), F.max("rn"), F.countDistinct("rn"))
    assert tuple(glob.first()) == (1, df.count(), df.count())


def test_overlay_keeps_base_rows(world, spark):
    from tessera.plans.catalog import _Camera
    cam = _Camera(spark, SF_SMALL)
    assert cam.overlay().count() == cam.base().count()


def test_packed_grid_equals_long_grid(world, spark):
    """Every lattice cell and a ring of off-grid cells: same tile (NULL off the grid)
    as the plain priority overlay joined to the lattice."""
    g = world.grid_by_overlay()
    probe = (spark.range(-1, world.width + 2).select(F.col("id").alias("cx"))
             .crossJoin(spark.range(-1, g.agg(F.max("y")).first()[0] + 3).select(F.col("id").alias("cy"))))
    packed = world.packed().lookup(probe)
    want = probe.join(g.select(F.col("x").alias("cx"), F.col("y").alias("cy"), "tile"), ["cx", "cy"], "left")
    assert packed.select("cx", "cy", "tile").exceptAll(want.select("cx", "cy", "tile")).count() == 0
    assert packed.count() == want.count()


def test_packed_grid_high_bits(spark):
    """Cells at bit 0 and bit 63 of a word whose mask is negative."""
    from tessera.operators.raster import PackedGrid
    cells = spark.createDataFrame([(0, 0), (63, 0), (64, 0), (127, 0)], "x int, y int")
    pg = PackedGrid.from_layers([(cells, ".")], 128, spark.createDataFrame([(0,)], "y long"))
    probe = spark.createDataFrame([(x, 0) for x in (0, 1, 62, 63, 64, 65, 126, 127, 128)], "cx int, cy int")
    got = {r.cx: r.tile for r in pg.lookup(probe).collect()}
    assert got == {0: ".", 1: "#", 62: "#", 63: ".", 64: ".", 65: "#", 126: "#", 127: ".", 128: None}


def test_asof_on_one_hot_key_equals_brute_force(world):
    """All events on one key: the bucketed running max equals the plain pair join
    (every action of the key within the tolerance), which is fine at this size."""
    from tessera.functions.num import epoch_micros
    from tessera.streaming.jobs import held_action
    tol = 100_000
    ev = world.table("events")
    ticks = ev.select(F.col("event_id").alias("tick_id"), F.lit(1).cast("long").alias("key"),
                      (epoch_micros("ts") + (F.col("event_id") % 4) * 50_000).alias("tick_us"))
    acts = world.actions().withColumn("key", F.lit(1).cast("long"))
    got = held_action(ticks, acts, tol)
    a = acts.select("key", epoch_micros("ts").alias("us"), "seq", "action")
    pairs = (ticks.join(a, "key")
             .filter((F.col("us") <= F.col("tick_us")) & (F.col("tick_us") - F.col("us") <= tol)))
    best = pairs.groupBy("tick_id").agg(F.max_by("action", F.struct("us", "seq")).alias("action"))
    want = ticks.join(best, "tick_id", "left").select("tick_id", "key", "tick_us", "action")
    assert _same_rows(got, want)


def test_numbering_and_running_sums_keep_null_rows(spark):
    df = spark.createDataFrame([(None, None, 1, 1), (None, dt.datetime(2024, 1, 1), 2, 2), (1, None, 3, 4), (1, dt.datetime(2024, 1, 1), 4, 8),
                                (None, dt.datetime(2024, 1, 1), 5, 16)], "key long, ts timestamp_ntz, seq long, v long")
    rn = {r.seq: r.rn for r in number_rows(df, ["ts", "seq"], group=["key"]).collect()}
    assert rn == {1: 1, 2: 2, 5: 3, 3: 1, 4: 2}
    sums = {r.seq: r.s for r in prefix_sums(df, "key", F.col("ts").cast("date").cast("string").substr(9, 2).cast("long"), ["ts", "seq"], {"s": F.col("v")}).collect()}
    assert sums == {1: 1, 2: 3, 5: 19, 3: 4, 4: 12}


def test_numbering_runs_no_job_before_it_is_asked_for(spark):
    """Row numbers on strings, with ties in the group, over many buckets."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("n"), (F.col("id") * 7919 % 3000).cast("string")).alias("name"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    out = number_rows(df, ["name"], group=["g"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("name")))
    assert _same_rows(out, want)


def test_numbering_buckets_grow_and_rows_are_sorted_once(spark):
    """The number of ranges follows the cluster, the binary search cuts them evenly, and one
    exchange and one sort carry the rows."""
    df = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("k"), F.lit("x" * 50).alias("wide"))
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        seen = []
        for parts in ("8", "100", "400"):
            spark.conf.set(key, parts)
            seen.append(bucket_count(df))
            out = number_rows(df, ["k"])
            assert out.filter(F.col("rn") != F.col("k") + 1).count() == 0 and out.count() == 20000
        assert seen == sorted(set(seen))
    finally:
        spark.conf.set(key, before)
    plan = number_rows(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number") == 1 and plan.count("wide#") > 0
    rows_moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(_g#" in line]
    assert len(rows_moved) <= 2          # the rows, and the partial counts
    for buckets in (1, 2, 7, 5000):
        assert number_rows(df, ["k"], buckets=buckets).filter(F.col("rn") != F.col("k") + 1).count() == 0


def test_numbering_once_equals_numbering(spark):
    df = spark.createDataFrame([(g, i * 7 % 50, f"n{i}") for i in range(50) for g in (None, "a", "b")[:1 + i % 3]],
                               "g string, k long, name string")
    for group in (None, ["g"]):
        order = ["k"] if group else ["g", "k"]
        for pieces in (None, 1, 9):
            assert _same_rows(number_rows_once(df, order, group, pieces=pieces), number_rows(df, order, group))
    assert number_rows_once(df.filter("false"), ["k"]).count() == 0 and number_rows(df.filter("false"), ["k"]).count() == 0


def test_asof_null_keys_match_nothing(spark):
    from tessera.functions.asof import asof_backward
    ticks = spark.createDataFrame([(None, 5), (1, 5)], "key long, t long")
    acts = spark.createDataFrame([(None, 5, "a"), (1, 5, "b")], "key long, t2 long, act string")
    got = {r.key: r.match and r.match.act for r in asof_backward(ticks, acts, "key", "t", "t2", [], ["act"], 10).collect()}
    assert got == {None: None, 1: "b"}


def test_sparse_and_large_part_keys(spark, tmp_path):
    """A part key of 2e10 makes one more band, not an empty world up to it."""
    spark.createDataFrame([(k, k % 40 + 5) for k in (1, 7, 20_000_000_000)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    w = World(spark, str(tmp_path))
    assert w.grid().count() == 2 * w.wp.tile_w * w.wp.tile_h
    assert w.grid().agg(F.max("y")).first()[0] == (20_000_000_000 // 200 + 1) * w.wp.tile_h - 1 == w.lattice().agg(F.max(w.max_y)).first()[0]


def _brute_hits(actors, shots, damage):
    hp = {a: h for a, _, h in actors}
    pairs = [(o, a, p) for p, (o, c) in enumerate(shots) for a, d, _ in actors if o is not None and c == d and o != a]
    hit = {a for _, a, _ in pairs}
    hp = {a: h - damage if a in hit else h for a, h in hp.items()}
    return hp, {o for o, a, _ in pairs if hp[a] <= 0}, {p for *_, p in pairs}


def test_hits_without_pairs_equal_hits_by_pairs(spark):
    import random
    from tessera.operators import state
    rnd = random.Random(3)
    for cells, n in ((6, 25), (1, 8), (40, 30)):
        actors = [(i, rnd.randrange(cells), rnd.choice([10, 50, 51, 100])) for i in range(n)]
        shots = [(rnd.choice([None, *range(n + 2)]), rnd.randrange(cells)) for _ in range(2 * n)]
        a = spark.createDataFrame([(i, float(c), 0.0, h, 0) for i, c, h in actors], "id long, x double, y double, hp int, score int")
        p = spark.createDataFrame([(k, o, float(c), 0.0) for k, (o, c) in enumerate(shots)], "pid long, owner long, x double, y double")
        hp, winners, gone = _brute_hits(actors, shots, 50)
        out = state.apply_hits(a, state.cell_hits(a, p, 50), 50).collect()
        assert {r.id: r.hp for r in out} == hp and {r.id for r in out if r.score} == winners & set(hp)
        assert {r.pid for r in state.expire_hits(p, a).collect()} == set(range(len(shots))) - gone


def test_hits_have_no_window_by_cell(spark):
    from tessera.operators import state
    a = spark.range(9).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(50).alias("hp"), F.lit(0).alias("score"))
    p = spark.range(9).select(F.col("id").alias("owner"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    for df in (state.apply_hits(a, state.cell_hits(a, p, 50), 50), state.expire_hits(p, a)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" in plan


def test_hits_in_one_hot_cell(spark):
    """10,000 projectiles and 10,000 actors in one cell: no pairs are made."""
    from tessera.operators import state
    a = spark.range(10_000).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(50).alias("hp"), F.lit(0).alias("score"))
    p = spark.range(10_000).select(F.col("id").alias("owner"), F.lit(1.2).alias("x"), F.lit(0.9).alias("y"))
    out = state.apply_hits(a, state.cell_hits(a, p, 50), 50)
    assert out.filter("hp = 0 and score = 1").count() == 10_000
    assert state.expire_hits(p, a).count() == 0


def test_credit_reads_projectiles_once(spark):
    from tessera.plans.catalog import QUERIES
    plan = QUERIES["m_credit"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert sum("lineitem.parquet" in line for line in plan.splitlines()) == 1


def test_trajectory_drifts_less_than_stated(world):
    """Rounded steps against the unrounded running sum: n steps are within n * 0.5e-9."""
    from tessera.operators import state
    t = state.trajectory(world.actors(), world.actions(), world.sp)
    w = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("action") == "w", 1.0).when(F.col("action") == "s", -1.0).otherwise(0.0) * world.sp.move_speed
    st = world.actors().select(F.col("id").alias("key"), F.col("x").alias("x0"))
    u = (t.join(st, "key", "left").withColumn("x0", F.coalesce("x0", F.lit(world.sp.spawn_x)))
         .withColumns({"want": F.col("x0") + F.sum(step * F.cos("dir")).over(w), "n": F.count("*").over(w)}))
    assert u.filter(F.abs(F.col("x") - F.col("want")) > F.col("n") * 0.5e-9 + 1e-9).count() == 0


def _fold(events, cap, iv):
    """The plain fold of one key's (us, seq, action), in order."""
    out, tok, last = [], cap, None
    for us, _, act in sorted(events):
        last = (us + 500_000) // 1_000_000 * 1_000_000 if last is None else last
        ok = int(act == "x" and tok > 0)
        tok -= ok
        if tok != cap and (us - last) // iv > 0:
            tok, last = min(cap, tok + (us - last) // iv), (us + 500_000) // 1_000_000 * 1_000_000
        out.append((ok, tok))
    return out


@pytest.mark.parametrize("cap,iv,span", [(3, 60, 900), (1, 1, 40), (2, 3, 60), (5, 600, 200_000), (3, 86_400, 2_000_000)])
def test_token_bucket_equals_the_plain_fold(spark, cap, iv, span):
    """Many small keys and one key with a third of all rows, dense and over several days;
    ties in time, a NULL key, and events without a time."""
    import random
    from tessera.operators import state
    rnd = random.Random(cap * iv)
    base, rows = 1_704_067_200_000_000, []
    for key in [0] * 400 + [None] * 40 + [rnd.randrange(1, 30) for _ in range(800)]:
        rows.append((key, base + rnd.choice([rnd.randrange(span * 1_000_000), rnd.randrange(span) * 1_000_000, rnd.randrange(3) * 500_000]),
                     len(rows), rnd.choice("xxw")))
    df = spark.createDataFrame(rows, "key long, us long, seq long, action string")
    df = df.withColumn("ts", F.timestamp_add("MICROSECOND", F.col("us"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")))
    timeless = df.limit(2).withColumns({"ts": F.lit(None).cast("timestamp_ntz"), "seq": F.col("seq") + 10_000})
    got = {r.seq: (r.allowed, r.tokens) for r in state.token_bucket(df.union(timeless), cap, iv).collect()}
    assert [got.pop(s) for s in sorted(got) if s >= 10_000] == [(0, None)] * 2
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((us, seq, act) for k, us, seq, act in rows if k == key)
        want.update({seq: v for (_, seq, _), v in zip(mine, _fold(mine, cap, iv * 1_000_000))})
    assert got == want


def test_lod_table_by_brute_force(spark):
    """Thresholds in one bin, in far bins, equal ones, NULL and NaN on both sides, negative and
    huge depths, strict comparison."""
    import random
    from tessera.operators import camera
    rnd = random.Random(8)
    nan = float("nan")
    lod = [(rnd.choice(["a", "b", None]), rnd.choice([None, nan, -3.0, 0.0, 0.25, 0.5, 1e6, round(rnd.uniform(-2, 9), 2)]), rnd.randrange(5)) for _ in range(120)]
    lod += [("a", 2.01 + i * 1e-4, i % 5) for i in range(60)] + [("c", 4.0, 1), ("c", 4.0, 3)]
    rows = [(i, rnd.choice(["a", "b", "c", "d", None]), rnd.choice([None, nan, -9.0, 0.0, 0.25, 0.5, 4.0, 4.0001, 1e7, rnd.uniform(-3, 10)]), 9) for i in range(400)]

    def best(kind, depth):
        fits = [(m, s) for k, m, s in lod if k is not None and k == kind and m is not None and m == m and depth is not None and depth == depth and m < depth]
        return max(fits)[1] if fits else 9
    df = spark.createDataFrame(rows, "id int, kind string, depth double, stamp_id int").repartition(4)
    table = spark.createDataFrame(lod, "kind string, min_depth double, stamp_id int")
    want = {i: best(k, x) for i, k, x, _ in rows}
    for width in (0.25, 100.0, 0.01):
        out = camera.choose_lod_table(df, table, width)
        assert {r.id: r.eff_stamp for r in out.collect()} == want and out.columns == [*df.columns, "eff_stamp"]
    assert {r.eff_stamp for r in camera.choose_lod_table(df, table.filter("false")).collect()} == {9}
    assert camera.choose_lod_table(df.filter("false"), table).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lod_table_equals_the_fixed_chain(spark):
    from tessera.operators import camera
    from tessera.plans.catalog import _Camera
    from tessera.sources.world import LOD
    cam = _Camera(spark, SF_SMALL)
    table = spark.createDataFrame(LOD, "kind string, min_depth double, stamp_id int")
    cols = ["obs_id", "target_id", "eff_stamp"]
    assert _same_rows(camera.choose_lod_table(cam.projected, table).select(*cols), camera.choose_lod(cam.projected, LOD).select(*cols))


def test_overlap_counts_by_brute_force(spark):
    """Overlaps, touching and equal rectangles, removed ones, pieces cut anywhere, a row that all share,
    reversed and NULL corners, negative places."""
    import random
    from collections import Counter
    from tessera.operators import raster
    rnd = random.Random(2)
    rects = []
    for _ in range(60):
        x, y = rnd.randrange(-20, 60), rnd.randrange(-5, 12)
        rects.append((x, y, x + rnd.randrange(-1, 25), y + rnd.randrange(-1, 4), rnd.choice([1, 1, 1, 2, -1])))
    rects += [(3, 0, 40, 0, 1)] * 30 + [(None, 1, 2, 2, 1), (0, None, 2, 2, 1), (0, 0, 5, 1, None), (7, 3, 7, 3, 0)]
    want = Counter()
    for x1, y1, x2, y2, w in rects:
        if None not in (x1, y1, x2, y2, w):
            for x in range(x1, x2 + 1):
                for y in range(y1, y2 + 1):
                    want[x, y] += w
    want = {c: n for c, n in want.items() if n}
    df = spark.createDataFrame(rects, "x1 int, y1 int, x2 int, y2 int, w int").repartition(4)
    for bucket in (4096, 7, 1):
        runs = raster.overlap_runs(df, "w", bucket).collect()
        cells = [((x, r.y), r.n) for r in runs for x in range(r.x1, r.x2 + 1)]
        assert dict(cells) == want and len(cells) == len(want)
    assert {(r.x, r.y): r.n for r in raster.overlap_counts(df, "w").collect()} == want
    assert raster.overlap_runs(df.filter("false")).count() == 0


def test_a_large_rectangle_costs_its_height(spark):
    from tessera.operators import raster
    big = spark.createDataFrame([(0, 0, 9999, 9999, 1), (100, 100, 199, 149, 1), (100, 100, 199, 149, -1), (5000, 9000, 20000, 9001, 1)],
                                "x1 long, y1 long, x2 long, y2 long, w int")
    runs = raster.overlap_runs(big, "w")
    got = runs.groupBy("x1", "x2", "n").agg(F.count("*").alias("rows"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()
    assert {tuple(r) for r in got} == {(0, 9999, 1, 9998, 0, 9999), (0, 4999, 1, 2, 9000, 9001), (5000, 9999, 2, 2, 9000, 9001),
                                       (10000, 20000, 1, 2, 9000, 9001)}


def test_coverage_bitmaps_by_brute_force(spark):
    """Blocks of 32,768 cells and their borders, observers without a team or a cell, one cell that all see."""
    import random
    from tessera.operators import camera
    rnd = random.Random(3)
    width = 1000
    seen = {(i, rnd.randrange(width), rnd.randrange(200)) for i in range(30) for _ in range(rnd.randrange(40))}
    seen |= {(i, 768, 32) for i in range(30)} | {(i, 767, 32) for i in range(0, 30, 2)} | {(31, 0, 0), (31, 999, 10 ** 9)}
    teams = {i: rnd.choice([None, 1, 2]) for i in range(33)}
    cells = spark.createDataFrame(sorted(seen), "id long, tile_x long, tile_y long").repartition(5)
    out = camera.coverage_rollup(camera.coverage_bitmaps(cells, width), spark.createDataFrame(list(teams.items()), "id long, team int")).collect()
    want = {("world", None, None): len({c[1:] for c in seen})}
    for i in {c[0] for c in seen}:
        want["observer", teams[i], i] = len([c for c in seen if c[0] == i])
    for t in {teams[c[0]] for c in seen}:
        want["team", t, None] = len({c[1:] for c in seen if teams[c[0]] == t})
    assert {(r.level, r.team, r.id): r.cells_seen for r in out} == want and len(out) == len(want)


def test_one_march_feeds_all_coverage_counts(spark):
    from tessera.plans.catalog import QUERIES
    import re
    for key, marches in (("l_first_hit", 1), ("c_coverage_bitmaps", 1), ("c_coverage_stats", 0)):      # 0: read back
        plan = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Generate .*\[n#\d+\]", plan)) == marches, key


@pytest.mark.parametrize("cells,words", [(20, 1), (40, 2), (75, 3)])
def test_distance_field_by_brute_force(cells, words):
    """Also across the words of a row."""
    import numpy as np
    from tessera.operators import sight, skip
    rnd = np.random.default_rng(cells)
    code = rnd.choice([sight.OFF, sight.OPEN, sight.MARKED, sight.BLOCKED], size=(3, 17, cells), p=[.3, .4, .28, .02])
    near = np.zeros((3, 17, words), np.uint64)
    for x in range(cells):
        near[:, :, x // 31] |= code[:, :, x].astype(np.uint64) << np.uint64(2 * (x % 31))
    field = skip.distance_field(near)
    for o in range(3):
        walls = np.argwhere(code[o] == sight.BLOCKED)
        for y in range(17):
            for x in range(cells):
                got = sum(int(field[k, o, y, x // 31] >> np.uint64(2 * (x % 31)) & np.uint64(1)) << k for k in range(3))
                far = min((max(abs(y - v), abs(x - u)) for v, u in walls), default=99)
                assert got == min(far, skip.FAR)


def test_skipped_hits_equal_marched_hits(world, spark):
    """In the world, and in a large empty one with a long view, axis-parallel rays and observers off
    the grid; at most a third of the samples, and no step is shuffled."""
    from tessera.operators import sight, skip
    from tessera.operators.raster import PackedGrid
    got = skip.skip_hits(world.actors(), world.packed(), world.vp)
    assert _same_rows(got.select("id", "col", "n", q6("dist").alias("d")), sight.first_hit(world.actors(), world.packed(), world.vp).select("id", "col", "n", q6("dist").alias("d")))
    samples = world.actors().count() * (world.vp.view_w + 1) * world.vp.max_steps
    assert 0 < got.agg(F.sum("probes")).first()[0] * 3 <= samples
    rnd = __import__("random").Random(5)
    open_ = [(x, y) for x in range(150) for y in range(90) if rnd.random() > 0.01]
    grid = PackedGrid.from_layers([(spark.createDataFrame(open_, "x long, y long"), ".")], 150, spark.range(90).selectExpr("id AS y"))
    obs = [(i, rnd.uniform(-5, 155), rnd.uniform(-5, 95), rnd.uniform(-7, 7)) for i in range(30)]
    obs += [(40 + i, 75.013, 45.017, i * 3.141592653589793 / 2) for i in range(4)] + [(50, None, 1.0, 1.0), (51, 1.0, 1.0, None)]
    df = spark.createDataFrame(obs, "id long, x double, y double, dir double")
    view = ViewParams(max_steps=350, view_w=33)
    want = sight.first_hit(df.filter("x is not null and dir is not null"), grid, view).select("id", "col", "n", q6("dist").alias("d"))
    out = skip.skip_hits(df, grid, view)
    assert want.count() > 100 and _same_rows(out.select("id", "col", "n", q6("dist").alias("d")), want)
    assert out.agg(F.sum("probes")).first()[0] * 3 <= 34 * 34 * 350
    plan = skip.skip_hits(world.actors(), world.packed(), world.vp)._jdf.queryExecution().executedPlan().toString()
    head = plan[:plan.index("MapInArrow")] + plan[plan.index("MapInArrow"):].split("SortAggregate")[0].split("ObjectHashAggregate")[0]
    assert "Exchange" not in head


@pytest.mark.parametrize("seed", range(30))
def test_fold_of_shots_equals_one_event_at_a_time(seed):
    import random
    import numpy as np
    from tessera.operators.state import round_second
    from tessera.streaming.jobs import fold_shots
    rnd = random.Random(seed)
    cap, iv = rnd.choice([1, 2, 5]), rnd.choice([1, 3, 10]) * 1_000_000
    us = np.sort(np.array([rnd.randrange(60_000_000) for _ in range(rnd.choice([1, 5, 80, 400]))]))
    x = np.array([rnd.random() < rnd.choice([0.1, 0.5, 0.9]) for _ in us])
    tok, last = rnd.choice([(cap, round_second(int(us[0]))), (0, round_second(int(us[0])) - 5_000_000), (cap, 70_000_000)])
    allowed, left, tokens, clock = fold_shots(us, x, tok, last, cap, iv)
    want = []
    for t, shot in zip(us.tolist(), x.tolist()):
        ok = int(shot and tok > 0)
        tok -= ok
        if tok != cap and t - last >= iv:
            tok, last = min(cap, tok + (t - last) // iv), round_second(t)
        want.append((ok, tok))
    assert list(zip(allowed.tolist(), left.tolist())) == want and (tokens, clock) == (tok, last)


def test_targets_behind_walls_become_no_pixels(spark):
    """The picture is the same without them, and they are gone before the stamps."""
    from tessera.plans.catalog import _Camera
    cam = _Camera(spark, SF_SMALL)
    view = cam.c.observer_view(cam.w.actors(), cam.grid, cam.w.vp)
    shown = cam.c.unhidden(cam.lod, cam.w.stamps(), view, cam.w.vp)
    top = cam.occluded()
    assert _same_rows(cam.c.occlude(cam.pixels(shown), sight.ray_extent(cam.rays), cam.w.vp).select(*top.columns), top)
    assert top.select("obs_id", "target_id").distinct().exceptAll(shown.select("obs_id", "target_id")).count() == 0
    assert shown.count() < cam.lod.count()
    from tessera.operators import report
    drawn = report.lines(cam.with_top(view, crowded=True), cam.row_array(), out="row", first=0)
    assert _same_rows(drawn, cam.rows())


def test_sums_before_once(spark):
    rows = [(g, i * 7 % 40, (i * 13) % 9 if i % 5 else None) for i in range(40) for g in (None, "a")]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    for group in ([], ["g"]):
        order = ["k"] if group else ["g", "k"]
        key = (lambda r: (r[0] is not None, r[0] or "", r[1]))
        for pieces in (None, 1, 11):
            out = sums_before_once(df, order, {"s": "v"}, group, pieces).collect()
            for r in out:
                before = [v or 0 for g, k, v in rows if (not group or g == r.g) and key((g, k)) < key((r.g, r.k))]
                assert r.s == sum(before)
            assert len(out) == len(rows)
