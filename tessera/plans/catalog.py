"""Registry of runnable queries: one per operator key.

Each query takes (spark, sf_dir) and returns a DataFrame over the whole driver
tables of that directory.  Computed columns carry the same names as the DuckDB
oracle in ``plans/oracle.py``; doubles that pass through trig are quantised to
1e-6 (``q6``) so the two engines agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.num import q6
from tessera.operators import raster, sight
from tessera.session import staged
from tessera.sources.world import World

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


# ---- R ------------------------------------------------------------------------

@query
def q_r_lattice(spark, sf):
    return World(spark, sf).lattice()


@query
def q_r_normalize_rects(spark, sf):
    return World(spark, sf).norm_rects()


@query
def q_r_filter_rects(spark, sf):
    w = World(spark, sf)
    return raster.filter_rects(w.norm_rects(), w.wp.min_room, w.wp.min_room)


@query
def q_r_rect_centroids(spark, sf):
    w = World(spark, sf)
    return raster.rect_centroids(
        raster.filter_rects(w.norm_rects(), w.wp.min_room, w.wp.min_room), keep=("k",))


@query
def q_r_rasterize_rects(spark, sf):
    return raster.rasterize_rects(World(spark, sf).norm_rects(), keep=("k",))


@query
def q_r_overlap_counts(spark, sf):
    """How many rectangles cover each cell, after every seventh was taken away again."""
    rects = World(spark, sf).norm_rects()
    gone = rects.filter(F.col("k") % 7 == 0).withColumn("weight", F.lit(-1))
    return raster.overlap_counts(rects.withColumn("weight", F.lit(1)).unionByName(gone), "weight")


@query
def q_r_classify_cells(spark, sf):
    return World(spark, sf).grid()


@query
def q_r_grid_extent(spark, sf):
    return raster.grid_extent(World(spark, sf).grid())


@query
def q_r_glyph_cells(spark, sf):
    """Every part name as text art: one line per word, padded with the transparent
    '.' to the longest word."""
    part = World(spark, sf).table("part")
    words = F.split(F.col("p_name"), " ")
    width = F.array_max(F.transform(words, lambda w: F.length(w)))
    lines = F.transform(words, lambda w: F.rpad(w, width, "."))
    return raster.glyph_cells(part.select("p_partkey", lines.alias("lines")),
                              "p_partkey", "lines")


# ---- L ------------------------------------------------------------------------

@query
def q_l_ray_fan(spark, sf):
    w = World(spark, sf)
    return sight.ray_fan(w.actors(), w.vp).select("id", "col", q6("angle").alias("angle"))


@query
def q_l_ray_march(spark, sf):
    w = World(spark, sf)
    m = sight.ray_march(w.actors(), w.packed(), w.vp)
    return m.select("id", "col", "n", "cx", "cy", q6("dist").alias("dist"), "tile")


@query
def q_l_visible_cells(spark, sf):
    w = World(spark, sf)
    return sight.visible_entries(w.actors(), w.packed(), w.vp).withColumn("dist", q6("dist"))


@query
def q_l_first_hit(spark, sf):
    w = World(spark, sf)
    return sight.first_hit(w.actors(), w.packed(), w.vp).select("id", "col", "n", q6("dist").alias("dist"))


@query
def q_l_skip_hits(spark, sf):
    """First hits by jumps over empty space."""
    from tessera.operators import skip
    w = World(spark, sf)
    return skip.skip_hits(w.actors(), w.packed(), w.vp).select("id", "col", "n", q6("dist").alias("dist"))


@query
def q_l_ray_depth(spark, sf):
    w = World(spark, sf)
    rays = sight.ray_summary(w.actors(), w.packed(), w.vp)
    return sight.ray_depth(rays, w.vp).select("id", "col", q6("angle").alias("angle"), q6("depth").alias("depth"))


@query
def q_l_ray_extent(spark, sf):
    w = World(spark, sf)
    return sight.ray_extent(sight.ray_summary(w.actors(), w.packed(), w.vp)).withColumn("extent", q6("extent"))


@query
def q_l_visible_cell_set(spark, sf):
    w = World(spark, sf)
    return sight.visible_cell_set(w.actors(), w.packed(), w.vp)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Rays with a first hit per observer: rects -> grid -> actors -> ray fan ->
    first hit, aggregated per observer."""
    w = World(spark, sf)
    return (sight.first_hit(w.actors(), w.packed(), w.vp).groupBy("id")
            .agg(F.count("*").alias("rays_hit"), F.min("n").alias("min_n"),
                 F.max("n").alias("max_n"), q6(F.avg("dist")).alias("avg_dist")))


# ---- C ------------------------------------------------------------------------

class _Camera:
    """The renderer's DataFrames for one world, composed lazily."""

    def __init__(self, spark, sf):
        from tessera.operators import camera
        from tessera.sources import world as world_mod
        self.c, self.w = camera, World(spark, sf)
        w, vp = self.w, self.w.vp
        self.grid = w.packed()
        self.frame = camera.observer_frame(w.actors(), w.targets(), vp)
        self.projected = camera.project(self.frame, vp)
        self.lod = camera.choose_lod(self.projected, world_mod.LOD)
        self.catalogue_rows = sum(s[2] * s[3] for s in world_mod.STAMPS)

    @cached_property
    def rays(self):
        return sight.ray_summary(self.w.actors(), self.grid, self.w.vp)

    @cached_property
    def depths(self):
        return sight.ray_depth(self.rays, self.w.vp)

    @cached_property
    def heights(self):
        return self.c.column_height(self.depths, self.w.vp)

    def base(self):
        return self.c.column_raster(self.heights, self.w.vp)

    def expanded(self, lod=None):
        return self.c.stamp_expand(lod or self.lod, self.w.stamps(), self.w.stamp_pixels(), self.w.vp,
                                   catalogue_rows=self.catalogue_rows)

    def spans(self, lod=None):
        return self.c.stamp_spans(self.expanded(lod), self.w.vp)

    def pixels(self, lod=None):
        return self.c.span_pixels(self.spans(lod))

    def occluded(self):
        return self.c.occlude(self.pixels(), sight.ray_extent(self.rays), self.w.vp)

    def nearest(self):
        return self.c.nearest_pixel(self.occluded())

    def with_top(self, view, crowded=False):
        """Views with their nearest target pixels; the rows of ``view_rows`` hide those
        behind the column's occluder.  ``crowded``: the views are written first and tell which
        targets stand behind walls and need no pixels; worth it where an observer has many
        targets near, and a second slower where it has few."""
        shown = None
        if crowded:
            view = staged(view, "views")
            shown = self.c.unhidden(self.lod, self.w.stamps(), view, self.w.vp, catalogue_rows=self.catalogue_rows)
        none = F.create_map().cast("map<int,array<struct<px:int,ch:string,depth:double>>>")
        top = self.c.top_pixels(self.c.nearest_pixel(self.pixels(shown)))
        return view.join(top, "id", "left").withColumn("top", F.coalesce("top", none))

    def view(self):
        return self.with_top(self.c.observer_view(self.w.actors(), self.grid, self.w.vp))

    def row_array(self):
        return self.c.view_rows(self.w.vp, by_row=True)

    def rows(self):
        from tessera.operators import report
        return report.lines(self.view(), self.row_array(), out="row", first=0)

    def overlay(self):
        return self.rows().select("id", F.posexplode(F.split("row", "")).alias("x", "ch"), "y").select("id", "x", "y", "ch")

    def cell_set(self):
        return sight.visible_cell_set(self.w.actors(), self.grid, self.w.vp)

    def coverage(self):
        w = self.w
        mobs = w.targets().select("x", "y", "icon").unionByName(w.actors().select("x", "y", "icon"))
        return self.c.coverage(w.actors(), self.grid, mobs, w.vp)


@query
def q_c_observer_frame(spark, sf):
    f = _Camera(spark, sf).frame
    return f.select("obs_id", "target_id", q6("depth").alias("depth"), q6("horiz").alias("horiz"))


@query
def q_c_project(spark, sf):
    p = _Camera(spark, sf).projected
    return p.select("obs_id", "target_id", "screen_x", "screen_y", q6("depth").alias("depth"))


@query
def q_c_lod(spark, sf):
    return _Camera(spark, sf).lod.select("obs_id", "target_id", F.col("eff_stamp").alias("stamp_id"))


@query
def q_c_unhidden(spark, sf):
    """Targets of which an observer may see a pixel: not wholly behind a wall."""
    cam = _Camera(spark, sf)
    view = cam.c.observer_view(cam.w.actors(), cam.grid, cam.w.vp)
    return cam.c.unhidden(cam.lod, cam.w.stamps(), view, cam.w.vp, catalogue_rows=cam.catalogue_rows).select("obs_id", "target_id")


@query
def q_c_lod_table(spark, sf):
    """Stamps from a table with a threshold per part, instead of three fixed ones."""
    cam = _Camera(spark, sf)
    return cam.c.choose_lod_table(cam.projected, cam.w.lod_table()).select("obs_id", "target_id", F.col("eff_stamp").alias("stamp_id"))


@query
def q_c_column_height(spark, sf):
    return _Camera(spark, sf).heights.select("id", "col", "height")


@query
def q_c_depth_band(spark, sf):
    cam = _Camera(spark, sf)
    return cam.depths.select("id", "col", cam.c.depth_band("depth", cam.w.vp).alias("band"))


@query
def q_c_column_raster(spark, sf):
    return _Camera(spark, sf).base()


@query
def q_c_stamp_expand(spark, sf):
    e = _Camera(spark, sf).expanded()
    return e.select("obs_id", "target_id", "sx", "sy", "ch",
                    q6("scale_x").alias("scale_x"), q6("scale_y").alias("scale_y"))


@query
def q_c_stamp_spans(spark, sf):
    s = _Camera(spark, sf).spans()
    return s.select("obs_id", "target_id", "sx", "sy", "ch", "x0", "x1", "y0", "y1")


@query
def q_c_span_pixels(spark, sf):
    p = _Camera(spark, sf).pixels()
    return p.select("obs_id", "target_id", "sx", "sy", "px", "py", "ch", q6("depth").alias("depth"))


@query
def q_c_occlusion(spark, sf):
    p = _Camera(spark, sf).occluded()
    return p.select("obs_id", "target_id", "sx", "sy", "px", "py", "ch", q6("depth").alias("depth"))


@query
def q_c_nearest_pixel(spark, sf):
    n = _Camera(spark, sf).nearest()
    return n.select("id", "px", "py", "ch", "target_id", q6("depth").alias("depth"))


@query
def q_c_overlay(spark, sf):
    return _Camera(spark, sf).overlay()


@query
def q_c_raster_rows(spark, sf):
    return _Camera(spark, sf).rows()


@query
def q_c_coverage_map(spark, sf):
    cam = _Camera(spark, sf)
    return cam.c.coverage_map(cam.coverage(), cam.w.vp)


@query
def q_c_coverage_stats(spark, sf):
    cam = _Camera(spark, sf)
    return cam.c.coverage_stats(cam.cell_set())


@query
def q_c_coverage_bitmaps(spark, sf):
    """Cells seen by each observer, by each team and by all, from bitmaps of one march."""
    cam = _Camera(spark, sf)
    return cam.c.coverage_rollup(cam.c.coverage_bitmaps(cam.cell_set(), cam.w.width), cam.w.actors().select("id", "team"))


# ---- J ------------------------------------------------------------------------

BULLET_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query
def q_j_cell_join(spark, sf):
    from tessera.operators import spatial
    w = World(spark, sf)
    victims = w.targets().filter(F.col("kind") == "player")
    c = spatial.cell_join(w.projectiles(), victims)
    return c.select(*BULLET_KEY, "owner", "victim_id", q6("victim_x").alias("victim_x"),
                    q6("victim_y").alias("victim_y"))


@query
def q_j_cell_lookup(spark, sf):
    from tessera.operators import spatial, state
    w = World(spark, sf)
    moved = state.advance(w.projectiles(), w.sp.projectile_speed)
    ok = spatial.cell_lookup(moved, w.packed())
    return ok.select(*BULLET_KEY, q6("x").alias("x"), q6("y").alias("y"))


@query
def q_j_blocked(spark, sf):
    from tessera.operators import spatial
    w = World(spark, sf)
    return spatial.blocked(w.projectiles(), w.packed()).select(*BULLET_KEY)


@query
def q_j_unblocked(spark, sf):
    from tessera.operators import spatial
    w = World(spark, sf)
    return spatial.unblocked(w.projectiles(), w.packed()).select(*BULLET_KEY)


@query
def q_j_out_of_bounds(spark, sf):
    from tessera.operators import spatial, state
    w = World(spark, sf)
    moved = state.advance(w.projectiles(), w.sp.projectile_speed).withColumn("kind", F.lit("bullet"))
    oob = spatial.out_of_bounds(moved, w.packed(), "kind", "bullet")
    return oob.select(*BULLET_KEY, q6("x").alias("x"), q6("y").alias("y"))


# ---- M ------------------------------------------------------------------------

REFILL_NOW = 1704067200 + 7200.5
REFILL_INTERVAL = 900
CLEAR_CUTOFF = "2024-01-15 00:00:00"


class _Tick:
    """One batch of the state machine over the fixture world: inputs -> moves ->
    turns -> spawn -> quota -> advance -> bounds -> walls -> hits -> credit ->
    expire -> respawn -> reset -> refill.  Stages are built on first use only."""

    def __init__(self, spark, sf):
        from tessera.operators import spatial, state
        self.s, self.j, self.w = state, spatial, World(spark, sf)

    @cached_property
    def grid(self):
        return self.w.packed()

    @cached_property
    def latest(self):
        return self.s.latest_action(self.w.actions())

    @cached_property
    def a1(self):
        return self.s.moves(self.w.actors(), self.latest, self.grid, self.w.sp)

    @cached_property
    def a2(self):
        return self.s.turns(self.a1, self.latest, self.w.sp)

    @cached_property
    def spawned(self):
        return self.s.spawn(self.a2, self.latest, self.w.sp)

    @cached_property
    def a3(self):
        return self.s.consume_quota(self.a2, self.latest)

    @cached_property
    def bullets(self):
        """All projectiles of this tick: those of the table, and the ones just spawned with
        ids after the largest actor id (their table keys are NULL)."""
        base = self.w.actors().agg(F.max("id")).scalar()
        new = self.s.assign_ids(self.spawned.select("owner", "x", "y", "dir"), ["owner"], base)
        old = self.w.projectiles().withColumn("id", F.lit(None).cast("long"))
        return old.unionByName(new, allowMissingColumns=True)

    @cached_property
    def adv(self):
        return self.s.advance(self.bullets, self.w.sp.projectile_speed)

    def _flying(self, moved):
        inside = self.j.out_of_bounds(moved, self.grid, inside=True)
        return self.j.unblocked(inside, self.grid)

    @cached_property
    def live(self):
        return self._flying(self.adv)

    @cached_property
    def a5(self):
        """After damage and credit.  Hits look at owners and places only, so the projectiles
        are taken here before the new ones get their ids."""
        cols = ["owner", "x", "y", "dir"]
        shots = self.w.projectiles().select(*cols).unionByName(self.spawned.select(*cols))
        live = self._flying(self.s.advance(shots, self.w.sp.projectile_speed))
        return self.s.apply_hits(self.a3, self.s.cell_hits(self.a3, live, self.w.sp.damage), self.w.sp.damage)

    @cached_property
    def remaining(self):
        return self.s.expire_hits(self.live, self.a3)

    @cached_property
    def a6(self):
        spawns = self.w.respawns().withColumn("tile", F.lit("R"))
        return self.s.respawn(self.a5, spawns, self.w.wp.respawn_seed)

    @cached_property
    def a7(self):
        return self.s.reset(self.a6, self.w.sp)

    @cached_property
    def a8(self):
        return self.s.refill(self.a7, REFILL_NOW, REFILL_INTERVAL, self.w.sp.ammo_max)


@query
def q_m_latest_action(spark, sf):
    return _Tick(spark, sf).latest


@query
def q_m_moves(spark, sf):
    return _Tick(spark, sf).a1.select("id", q6("x").alias("x"), q6("y").alias("y"))


@query
def q_m_turns(spark, sf):
    return _Tick(spark, sf).a2.select("id", q6("dir").alias("dir"))


@query
def q_m_spawn(spark, sf):
    s = _Tick(spark, sf).spawned
    return s.select("owner", q6("x").alias("x"), q6("y").alias("y"), q6("dir").alias("dir"),
                    "kind", "stamp_id", "icon", "world_w")


@query
def q_m_assign_ids(spark, sf):
    t = _Tick(spark, sf)
    base = t.w.actors().agg(F.max("id")).scalar()
    return t.s.assign_ids(t.spawned, ["owner"], base).select("id", "owner")


@query
def q_m_consume_quota(spark, sf):
    return _Tick(spark, sf).a3.select("id", "ammo")


@query
def q_m_advance(spark, sf):
    return _Tick(spark, sf).adv.select(*BULLET_KEY, "id", q6("x").alias("x"), q6("y").alias("y"))


@query
def q_m_apply_hits(spark, sf):
    return _Tick(spark, sf).a5.select("id", "hp")


@query
def q_m_credit(spark, sf):
    return _Tick(spark, sf).a5.select("id", "score")


@query
def q_m_expire_hits(spark, sf):
    return _Tick(spark, sf).remaining.select(*BULLET_KEY, "id")


@query
def q_m_respawn(spark, sf):
    a = _Tick(spark, sf).a6
    return a.select("id", q6("x").alias("x"), q6("y").alias("y"), q6("dir").alias("dir"))


@query
def q_m_reset(spark, sf):
    return _Tick(spark, sf).a7.select("id", "hp", "ammo")


@query
def q_m_refill(spark, sf):
    return _Tick(spark, sf).a8.select("id", "ammo", "last_refill")


@query
def q_m_upsert(spark, sf):
    """A stored table of current actions: created from the log before ``CLEAR_CUTOFF``, then
    brought up to date by the rest in one batch, in which a key whose last action is 'd'
    leaves."""
    from tessera.session import scratch_path
    from tessera.sources.state_table import StateTable
    from tessera.streaming.jobs import LATEST
    acts = World(spark, sf).actions().withColumn("gone", F.col("action") == "d")
    early = F.col("ts") < F.lit(CLEAR_CUTOFF).cast("timestamp_ntz")
    table = StateTable(spark, scratch_path(spark, "current"), ["key"], LATEST)
    table.create(acts.filter(early), order=["ts", "seq"])
    table.merge(acts.filter(~early), batch=0, order=["ts", "seq"], delete="gone")
    return table.read()


@query
def q_m_clear_actions(spark, sf):
    from tessera.operators import state
    w = World(spark, sf)
    acts = w.actions()
    done = state.latest_action(acts.filter(F.col("ts") < F.lit(CLEAR_CUTOFF).cast("timestamp_ntz")))
    return state.pending_actions(acts, done).select("key", "seq", "action")


@query
def q_m_get_or_create(spark, sf):
    from tessera.operators import state
    w = World(spark, sf)
    k = F.col("user_id")
    names = w.table("events").select(
        F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0")).alias("name"),
        F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (k % 26 + 1).cast("int"), 1).alias("icon"))
    g = state.get_or_create(w.actors(), names, w.sp)
    return g.withColumns({"x": q6("x"), "y": q6("y"), "dir": q6("dir")})


@query
def q_m_constraint_violations(spark, sf):
    from tessera.operators import state as s
    w = World(spark, sf)
    li, o, ev = w.table("lineitem"), w.table("orders"), w.table("events")
    parts = [
        s.pk_violations(li, ["l_orderkey", "l_linenumber"], "pk_lineitem"),
        s.pk_violations(ev, ["event_id"], "pk_events"),
        s.pk_violations(w.table("supplier"), ["s_name"], "unique_supplier_name"),
        s.not_null_violations(ev, ["user_id", "ts", "event_type"], ["event_id"], "not_null_events"),
        s.fk_violations(li, ["l_partkey"], w.table("part"), ["p_partkey"], "fk_lineitem_part"),
        s.fk_violations(li, ["l_suppkey"], w.table("supplier"), ["s_suppkey"], "fk_lineitem_supplier"),
        s.fk_violations(li, ["l_orderkey"], o, ["o_orderkey"], "fk_lineitem_orders"),
        s.fk_violations(o, ["o_custkey"], w.table("customer"), ["c_custkey"], "fk_orders_customer"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("check", "rule")


@query
def q_m_keyed_state(spark, sf):
    from tessera.operators import state
    w = World(spark, sf)
    shooters = w.actions().filter(F.col("action") == "x").select(F.col("key").alias("id"))
    k = state.keyed_state(w.actors(), shooters)
    return k.select("id", "name", q6("x").alias("x"), q6("y").alias("y"), q6("dir").alias("dir"))


@query
def q_m_trajectory(spark, sf):
    from tessera.operators import state
    w = World(spark, sf)
    t = state.trajectory(w.actors(), w.actions(), w.sp)
    return t.select("key", "seq", q6("x").alias("x"), q6("y").alias("y"), q6("dir").alias("dir"))


@query
def q_m_replay(spark, sf):
    """The whole action log against the walls of the world (``m_trajectory`` has none)."""
    from tessera.operators import replay
    w = World(spark, sf)
    t, _ = replay.replay(w.actors(), w.actions(), w.packed(), w.sp)
    return t.select("key", "seq", q6("x").alias("x"), q6("y").alias("y"), q6("dir").alias("dir"), "moved")


@query
def q_m_token_bucket(spark, sf):
    from tessera.operators import state
    w = World(spark, sf)
    t = state.token_bucket(w.actions(), w.wp.quota_max, w.wp.refill_interval_s)
    return t.select("key", "seq", "allowed", "tokens")


# ---- X ------------------------------------------------------------------------

def _status(spark, sf) -> DataFrame:
    from tessera.operators import report
    t = _Tick(spark, sf)
    return t.a8.select("id", "team", "score", report.status_line().alias("line"))


def _minimap(cam: _Camera):
    """(framed lines of the coverage window, their width) on the rows of ``cam.coverage()``."""
    from tessera.operators import report
    width = 2 * cam.w.vp.reach + 1
    return report.framed(cam.c.coverage_rows(cam.w.vp), width), width


@query
def q_x_status_bars(spark, sf):
    return _status(spark, sf).select("id", "line")


@query
def q_x_ranked_lines(spark, sf):
    from tessera.operators import report
    return report.ranked_lines(_status(spark, sf), ["team"], ["id"]).select("team", "id", "y", "line")


@query
def q_x_framed_union(spark, sf):
    from tessera.operators import report
    cam = _Camera(spark, sf)
    return report.lines(cam.coverage(), _minimap(cam)[0])


@query
def q_x_panel_zip(spark, sf):
    """View, minimap and the observer's own status line side by side (the list of all
    status lines is ``x_ranked_lines``: on every screen it would be observers x actors)."""
    from tessera.operators import report
    cam = _Camera(spark, sf)
    mini, mini_w = _minimap(cam)
    row = cam.with_top(cam.coverage()).join(_status(spark, sf).select("id", "line"), "id", "left")
    view = report.framed(cam.row_array(), cam.w.vp.view_w)
    own = F.array_compact(F.array("line"))
    # the three arrays are made once per observer, before they are read line by line
    panels = row.select("id", F.inline(F.array(F.struct(view.alias("a"), mini.alias("b"), own.alias("c")))))
    return report.lines(panels, report.panel_zip(F.col("a"), cam.w.vp.view_w, F.col("b"), mini_w, F.col("c")), out="full_row")


# ---- S ------------------------------------------------------------------------

@query
def q_s_latest_action(spark, sf):
    from tessera.streaming import jobs
    out = jobs.run_to_parquet(jobs.latest_action_windows(jobs.action_stream(spark, sf)), "s_latest_action")
    return out.select("key", "window_start", "window_end", "action", "ts", "seq")


@query
def q_s_upsert(spark, sf):
    """The current action of every key, kept in a stored table by the stream of actions."""
    from tessera.session import scratch_path
    from tessera.sources.state_table import StateTable
    from tessera.streaming import jobs
    table = StateTable(spark, scratch_path(spark, "current"), ["key"], jobs.LATEST)
    table.create(spark.createDataFrame([], jobs.LATEST))
    jobs.latest_action_table(jobs.action_stream(spark, sf), table)
    return table.read()


@query
def q_s_token_bucket(spark, sf):
    from tessera.streaming import jobs
    w = World(spark, sf)
    st = jobs.token_bucket_stream(jobs.action_stream(spark, sf), w.wp.quota_max, w.wp.refill_interval_s)
    return jobs.run_to_parquet(st, "s_token_bucket").select("key", "seq", "allowed", "tokens")


@query
def q_s_held_action(spark, sf):
    from tessera.functions.num import epoch_micros
    from tessera.streaming import jobs
    w = World(spark, sf)
    ticks = w.table("events").select(
        F.col("event_id").alias("tick_id"), F.col("user_id").alias("key"),
        (epoch_micros("ts") + (F.col("event_id") % 4) * 50_000).alias("tick_us"))
    return jobs.held_action(ticks, w.actions()).select("tick_id", "key", "tick_us", "action")


HELD_DELAY_S, HELD_TOLERANCE_US = 3600, 100_000


@query
def q_s_held_join(spark, sf):
    """Held actions from two streams; of ticks the watermark has passed for certain."""
    from tessera.functions.num import epoch_micros
    from tessera.streaming import jobs, keys
    acts = jobs.action_stream(spark, sf)
    tick_us = epoch_micros("ts") + (F.col("event_id") % 4) * 50_000
    ticks = keys.row_stream(spark, sf, "events").select(
        F.col("event_id").alias("tick_id"), F.col("user_id").alias("key"), tick_us.alias("tick_us"))
    pairs = jobs.run_to_parquet(keys.held_pairs(ticks, acts, HELD_TOLERANCE_US, f"{HELD_DELAY_S} seconds"), "s_held_join")
    last = World(spark, sf).actions().agg(F.max(epoch_micros("ts"))).scalar()
    return keys.held_of_pairs(pairs).filter(F.col("tick_us") < last - (HELD_DELAY_S + 1) * 1_000_000)


RELEASE_HOLD_S, RELEASE_DELAY_S = 6 * 3600, 3600


@query
def q_s_key_release(spark, sf):
    """Intervals in which a key was held, each press counting for ``RELEASE_HOLD_S``."""
    from tessera.streaming import jobs, keys
    out = keys.release_intervals(jobs.action_stream(spark, sf), RELEASE_HOLD_S * 1_000_000, f"{RELEASE_DELAY_S} seconds")
    return jobs.run_to_parquet(out, "s_key_release")


@query
def q_s_enforce_keys(spark, sf):
    """Lineitem as a stream against its primary key, NOT NULL and three foreign keys: how many
    rows of each key are accepted, and how many break which rule."""
    from tessera.streaming import keys
    w = World(spark, sf)
    good, bad = keys.enforce_keys(
        keys.row_stream(spark, sf, "lineitem"), "s_enforce_keys", ["l_orderkey", "l_linenumber"], "l_shipdate", "36500 days",
        required=["l_quantity"],
        parents=[("fk_orders", ["l_orderkey"], w.table("orders"), ["o_orderkey"]),
                 ("fk_part", ["l_partkey"], w.table("part"), ["p_partkey"]),
                 ("fk_supplier", ["l_suppkey"], w.table("supplier"), ["s_suppkey"])])
    rows = good.withColumn("rule", F.lit("accepted")).unionByName(bad)
    return rows.groupBy("rule", "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
