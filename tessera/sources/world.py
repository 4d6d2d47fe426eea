"""The fixture world, derived from the driver tables by integer formulas.

Nothing here is invented data: every row comes from a driver table, so all work
grows with the scale factor.

* rects       ``part``: one rectangle per part.  Parts are laid out in bands of
              ``parts_per_band`` keys; band b owns rows [b*tile_h, (b+1)*tile_h).
* grid        tile_w x tile_h cells for each band that has a part (coordinates are
              LONG, so sparse and large keys cost nothing): respawn > floor > wall.
* actors      ``supplier`` k standing near the centroid of the rectangle of part k
              (a floor cell by construction), with hp / ammo / score / refill clock.
* targets     ``customer``: points spread over the world, kind from the nation.
* projectiles ``lineitem``: points spread over the world, owned by ``l_suppkey``.
* actions     ``events``: key ``user_id``, order (ts, event_id), action letter.
* stamps      a catalogue of five elliptic stamps (a parameter table, like the
              reference's sprite catalogue).

The same formulas are written independently in DuckDB SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.joins import by_merge, dealt
from tessera.functions.num import idiv
from tessera.operators import raster
from tessera.params import StateParams, ViewParams, WorldParams
from tessera.sources.tables import read_table

# Event type -> action letter of the reference's input table
# (w forward, s back, a left turn, d right turn, x shoot).
ACTION_OF_EVENT = {"click": "w", "view": "s", "error": "a", "signup": "d", "purchase": "x"}

# The stamp catalogue (id, name, w, h, inner glyph, outer glyph).
# Sizes and ids follow the reference's five sprites; the art itself is a rule.
STAMPS = [
    (0, "player_16x20", 16, 20, "@", "#"),
    (1, "player_12x15", 12, 15, "@", "#"),
    (2, "player_8x10", 8, 10, "@", "#"),
    (3, "shot_12x12", 12, 12, "o", "+"),
    (4, "shot_6x6", 6, 6, "o", "+"),
]
# Level-of-detail table (kind, strict min depth, stamp id).
LOD = [("bullet", 4.0, 4), ("player", 6.0, 2), ("player", 3.0, 1)]

BASE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class World:
    def __init__(self, spark: SparkSession, sf_dir: str, wp: WorldParams | None = None,
                 vp: ViewParams | None = None, sp: StateParams | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.wp, self.vp, self.sp = wp or WorldParams(), vp or ViewParams(), sp or StateParams()
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One relation per table and query, so the files are listed once."""
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.sf_dir, name)
        return self._tables[name]

    # ---- extent ---------------------------------------------------------------
    @cached_property
    def last_band(self) -> Column:
        """The last band of the world, a scalar subquery over part keys."""
        return F.coalesce(self.table("part").agg(idiv(F.max("p_partkey"), self.wp.parts_per_band)).scalar(), F.lit(0))

    def bands(self) -> DataFrame:
        return self.table("part").filter("p_partkey is not null").select(
            idiv("p_partkey", self.wp.parts_per_band).alias("band")).distinct()

    def grid_rows(self) -> DataFrame:
        """(y): every row of cells that exists."""
        h = self.wp.tile_h
        return dealt(self.bands(), share=8).select(F.explode(F.sequence(F.col("band") * h, F.col("band") * h + (h - 1))).alias("y"))

    @property
    def width(self) -> int:
        return self.wp.tile_w

    @property
    def max_y(self) -> Column:
        return (self.last_band + 1) * self.wp.tile_h - 1

    # ---- rectangles and grid --------------------------------------------------
    @cached_property
    def _rects(self) -> DataFrame:
        w, h, n = self.wp.tile_w, self.wp.tile_h, self.wp.parts_per_band
        r = self.table("part").selectExpr(
            "p_partkey AS k", f"(p_partkey * 7919) % {w} AS ax", f"(p_partkey * 6101) % {h} AS ay",
            f"(p_partkey div {n}) * {h} AS y0", "p_size")
        r = r.selectExpr("k", "ax", "y0 + ay AS ay", f"least({w - 1}, ax + p_size % 24) AS bx",
                         f"y0 + least({h - 1}, ay + k % 10) AS by")
        return r.selectExpr("k", *[f"CAST(CASE WHEN k % 2 = 1 THEN {odd} ELSE {even} END AS BIGINT) AS {c}"
                                   for c, odd, even in (("x1", "bx", "ax"), ("y1", "by", "ay"), ("x2", "ax", "bx"), ("y2", "ay", "by"))])

    def rects(self) -> DataFrame:
        """(k, x1, y1, x2, y2), corners swapped for odd k (raw, not normalised)."""
        return self._rects

    @cached_property
    def _norm(self) -> DataFrame:
        return raster.normalize_rects(self.rects())

    def norm_rects(self) -> DataFrame:
        return self._norm

    def lattice(self) -> DataFrame:
        """(x, y) of every cell, from the bands of the parts."""
        return raster.band_lattice(self.grid_rows(), self.width)

    def floors(self) -> DataFrame:
        return raster.rasterize_rects(self.norm_rects())

    def respawns(self, rects: DataFrame | None = None) -> DataFrame:
        return raster.rect_centroids(
            raster.filter_rects(self.norm_rects() if rects is None else rects, self.wp.min_room, self.wp.min_room))

    def layers(self) -> list[tuple[DataFrame, str]]:
        """Priority layers of the grid, highest first: respawn > floor (> wall).  The
        rectangles are dealt by band, so a task adds up the words of its bands only."""
        rects = dealt(self.norm_rects(), idiv("k", self.wp.parts_per_band), share=8)
        return [(self.respawns(rects), raster.RESPAWN), (self.floor_runs(rects), raster.FLOOR)]

    def floor_runs(self, rects: DataFrame | None = None) -> DataFrame:
        """(x1, x2, y): the rows of the rectangles as runs of cells."""
        return (self.norm_rects() if rects is None else rects).selectExpr("x1", "x2", "explode(sequence(y1, y2)) AS y")

    def grid_by_overlay(self) -> DataFrame:
        """The grid as the plain priority overlay joined to the lattice (definition)."""
        return raster.classify_cells(self.lattice(), [(self.respawns(), raster.RESPAWN), (self.floors(), raster.FLOOR)])

    def grid(self) -> DataFrame:
        """(x, y, tile) for every cell: the packed rows, unpacked (no join)."""
        return self.packed().cells()

    def packed(self) -> raster.PackedGrid:
        """The same grid packed 64 cells per row (see ``raster.PackedGrid``), built
        from the layers without materialising the lattice."""
        return self._packed

    @cached_property
    def _packed(self) -> raster.PackedGrid:
        return raster.PackedGrid.from_layers(self.layers(), self.width, self.grid_rows(), max_y=self.max_y)

    # ---- points ---------------------------------------------------------------
    @cached_property
    def _actors(self) -> DataFrame:
        s = self.table("supplier")
        r = raster.rect_centroids(self.norm_rects(), keep=("k",)) \
            .withColumnRenamed("x", "cx").withColumnRenamed("y", "cy")
        # a supplier without such a part stands on the spawn cell
        return s.join(by_merge(r), F.col("s_suppkey") == F.col("k"), "left").selectExpr(
            "s_suppkey AS id", "s_name AS name", "s_nationkey AS team",
            f"coalesce(cx, {int(self.sp.spawn_x)}) + ((s_suppkey * 13) % 7 - 3) * 0.031D AS x",
            f"coalesce(cy, {int(self.sp.spawn_y)}) + ((s_suppkey * 17) % 5 - 2) * 0.043D AS y",
            "((s_suppkey * 29) % 63) * 0.1D + 0.013D AS dir",
            "CAST((s_suppkey * 37) % 100 + 1 AS INT) AS hp", "CAST(s_suppkey % 11 AS INT) AS ammo", "0 AS score",
            f"CAST({BASE_EPOCH} + (s_suppkey * 977) % 7200 AS BIGINT) AS last_refill", "'player' AS kind",
            "1.0D AS world_w", "1.0D AS world_h", "0 AS stamp_id",
            f"substring('{ALPHABET}', CAST(s_suppkey % 26 + 1 AS INT), 1) AS icon")

    def actors(self) -> DataFrame:
        """id, name, team, x, y, dir, hp, ammo, score, last_refill, kind, world_w,
        world_h, stamp_id, icon."""
        return self._actors

    @cached_property
    def _world_y(self) -> Column:
        """Height of the world in hundredths."""
        return (self.last_band + 1) * (self.wp.tile_h * 100)

    @cached_property
    def _targets(self) -> DataFrame:
        c = self.table("customer").select("c_custkey", "c_name", (F.col("c_nationkey") % 2 == 0).alias("p"), self._world_y.alias("h"))
        return c.selectExpr(
            "c_custkey AS id", "c_name AS name", "CASE WHEN p THEN 'player' ELSE 'bullet' END AS kind",
            f"((c_custkey * 7919) % {self.wp.tile_w * 100}) / 100.0D + 0.003D AS x",
            "((c_custkey * 6101) % h) / 100.0D + 0.007D AS y",
            "CASE WHEN p THEN 1.0D ELSE 0.5D END AS world_w", "CASE WHEN p THEN 1.0D ELSE 0.5D END AS world_h",
            "CASE WHEN p THEN 0 ELSE 3 END AS stamp_id",
            f"CASE WHEN p THEN substring('{ALPHABET}', CAST(c_custkey % 26 + 1 AS INT), 1) ELSE '*' END AS icon")

    def targets(self) -> DataFrame:
        """id, name, kind, x, y, world_w, world_h, stamp_id, icon."""
        return self._targets

    def projectiles(self) -> DataFrame:
        """Bullet key (l_orderkey, l_linenumber, l_partkey, l_suppkey), owner, x, y, dir."""
        key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        return self.table("lineitem").select(*key, self._world_y.alias("h")).selectExpr(
            *key, "l_suppkey AS owner",
            f"((l_partkey * 7919 + l_linenumber * 131) % {self.wp.tile_w * 100}) / 100.0D + 0.003D AS x",
            "((l_suppkey * 6101 + l_orderkey * 17) % h) / 100.0D + 0.007D AS y",
            "((l_orderkey * 31 + l_linenumber * 7) % 63) * 0.1D + 0.011D AS dir")

    def actions(self) -> DataFrame:
        """key, ts, seq, action (events of the five mapped types)."""
        m = F.create_map(*[F.lit(x) for kv in ACTION_OF_EVENT.items() for x in kv])
        ev = self.table("events")
        return (ev.select(F.col("user_id").alias("key"), F.col("ts"),
                          F.col("event_id").alias("seq"),
                          m[F.col("event_type")].alias("action"))
                .filter(F.col("action").isNotNull()))

    def lod_table(self) -> DataFrame:
        """(kind, min_depth, stamp_id): one level-of-detail threshold per part."""
        return self.table("part").selectExpr(
            "CASE WHEN p_partkey % 3 = 0 THEN 'bullet' ELSE 'player' END AS kind",
            "((p_partkey * 6151) % 1200) / 100.0D AS min_depth", "CAST(p_partkey % 5 AS INT) AS stamp_id")

    # ---- parameter tables -----------------------------------------------------
    def stamps(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(i, n, w, h) for i, n, w, h, _, _ in STAMPS], "stamp_id int, name string, w int, h int")

    def stamp_pixels(self) -> DataFrame:
        """(stamp_id, sx, sy, ch): every pixel of every stamp, NULL = transparent.
        Opaque inside the inscribed ellipse, inner glyph inside half its radius
        (integer arithmetic only)."""
        rows = [(i, w, h, a, b) for i, _, w, h, a, b in STAMPS]
        cat = self.spark.createDataFrame(rows, "stamp_id int, w int, h int, inner string, outer string")
        px = cat.select("*", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("i"))
        sx = (F.col("i") % F.col("w")).cast("int")
        sy = idiv("i", F.col("w")).cast("int")
        px = px.select("stamp_id", "w", "h", "inner", "outer", sx.alias("sx"), sy.alias("sy"))
        ex = (2 * F.col("sx") + 1 - F.col("w")) * (2 * F.col("sx") + 1 - F.col("w")) * F.col("h") * F.col("h")
        ey = (2 * F.col("sy") + 1 - F.col("h")) * (2 * F.col("sy") + 1 - F.col("h")) * F.col("w") * F.col("w")
        r2 = F.col("w") * F.col("w") * F.col("h") * F.col("h")
        ch = (F.when(4 * (ex + ey) <= r2, F.col("inner"))
               .when(ex + ey <= r2, F.col("outer")))
        return px.select("stamp_id", "sx", "sy", ch.alias("ch"))
