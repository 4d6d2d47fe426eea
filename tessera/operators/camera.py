"""C - observer frame, projection, stamping and compositing.

Frame
  The reference rotates *every* target into *every* observer's frame (a cross
  join).  Here the frame is range-bounded: targets are binned into square bins of
  side >= the draw radius and each observer probes the 3 x 3 bins around its own, an
  equi-join on the bin followed by an exact distance filter.  The radius follows from
  the view and the widest target (``ViewParams.frame_radius``).  Rule: nothing beyond
  the ray length is drawn.  On the grid this is what occlusion does anyway; a column
  that sees no cell (an observer off the grid) shows targets up to the ray length, where
  the reference shows them at any distance.

Pixels
  Every per-observer expansion (129 columns x 65 rows, stamp spans clamped to the
  screen, a coverage window of (2r+1)^2 cells) is bounded by parameters, never by
  data, so no group grows with the tables.

Views
  ``observer_view`` gathers one march into one row per observer: its columns and the set
  of cells it sees.  Raster rows and coverage rows are built from that row, so only
  sparse things are joined to it by id: the nearest target pixel per screen cell, and
  the icons around the observer.  The nearest pixel may be chosen before occlusion:
  occlusion compares a pixel's depth with one number per column, so if the nearest is
  hidden all are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import bounded_broadcast, dealt
from tessera.functions.num import cell, explode_range, floor_cell, idiv
from tessera.operators import sight
from tessera.params import ViewParams
from tessera.session import staged

# Fixed depth-band glyphs of the reference renderer, nearest first, then sky/ground.
BAND_GLYPHS = ("█", "▓", "▒", "░")
SKY, GROUND = " ", "."


def observer_frame(observers: DataFrame, targets: DataFrame, vp: ViewParams = ViewParams(),
                   keep: tuple[str, ...] = ("kind", "world_w", "world_h", "stamp_id", "icon")) -> DataFrame:
    """(obs_id, target_id, *keep, depth, horiz) for targets within the draw radius."""
    widest = F.coalesce(targets.agg(F.max("world_w")).scalar(), F.lit(0.0))
    radius = vp.frame_radius(widest)
    b = F.ceil(radius)
    t = targets.select(F.col("id").alias("target_id"), F.col("x").alias("tx"),
                       F.col("y").alias("ty"), *keep,
                       F.floor(F.col("x") / b).alias("bx"), F.floor(F.col("y") / b).alias("by"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    o = (observers.select(F.col("id").alias("obs_id"), F.col("x").alias("ox"),
                          F.col("y").alias("oy"), F.col("dir").alias("odir"))
         .select("*", F.explode(near).alias("dbx"))
         .select("*", F.explode(near).alias("dby"))
         .select("obs_id", "ox", "oy", "odir",
                 (F.floor(F.col("ox") / b) + F.col("dbx")).alias("bx"),
                 (F.floor(F.col("oy") / b) + F.col("dby")).alias("by")))
    dx, dy = F.col("tx") - F.col("ox"), F.col("ty") - F.col("oy")
    j = o.join(t, ["bx", "by"]).filter(dx * dx + dy * dy <= radius * radius)
    a = -F.col("odir")
    return j.select("obs_id", "target_id", *keep,
                    (dx * F.cos(a) - dy * F.sin(a)).alias("depth"),
                    (dx * F.sin(a) + dy * F.cos(a)).alias("horiz"))


def project(frame: DataFrame, vp: ViewParams = ViewParams()) -> DataFrame:
    """Keep depth > 0.1; screen_x = round_half_even(view_w/2 + horiz/depth * pf)."""
    pf = vp.projection_factor
    return (frame.filter(F.col("depth") > F.lit(0.1))
            .withColumn("screen_x", cell(F.lit(vp.view_w // 2) + (F.col("horiz") / F.col("depth")) * F.lit(pf)).cast("int"))
            .withColumn("screen_y", F.lit(vp.view_h // 2)))


def choose_lod(projected: DataFrame, lod_rows, default_col: str = "stamp_id") -> DataFrame:
    """Stamp by kind and depth from a small LOD table of (kind, min_depth, stamp_id):
    the entry with the largest ``min_depth`` strictly below the depth wins, else the
    target's own stamp.  The table is a parameter, folded into a CASE chain."""
    expr = None
    for kind, min_depth, stamp in sorted(lod_rows, key=lambda r: (r[0], -r[1])):
        cond = (F.col("kind") == kind) & (F.col("depth") > F.lit(float(min_depth)))
        expr = F.when(cond, F.lit(stamp)) if expr is None else expr.when(cond, F.lit(stamp))
    eff = F.col(default_col) if expr is None else expr.otherwise(F.col(default_col))
    return projected.withColumn("eff_stamp", eff.cast("int"))


def choose_lod_table(projected: DataFrame, lod: DataFrame, bin_width: float = 0.25, kind: str = "kind", depth: str = "depth",
                     default_col: str = "stamp_id", out: str = "eff_stamp") -> DataFrame:
    """``choose_lod`` with a table (kind, min_depth, stamp_id) of any size: the entry of the
    row's kind with the largest ``min_depth`` strictly below its depth, else the row's own
    stamp.  Entries with equal ``min_depth`` give the largest stamp.

    An interval join without a theta join.  Depths fall into bins; the rows join by (kind,
    bin) with one row that has the bin's own thresholds and the last one of all bins before
    (the carry).  Only bins that hold a row or a threshold exist; the carry is a running
    value over them, a bin each.  A kind or bin with a third of all rows is a join whose rows
    can be split, and no group.  A NULL (or NaN) threshold or kind fits nothing; a row with a
    NULL kind or depth keeps its own stamp."""
    def bin_of(c):
        return F.floor(c / F.lit(bin_width)).cast("long")
    low, row_depth = F.col("min_depth").cast("double"), F.col(depth).cast("double")
    entries = (lod.filter(F.col("kind").isNotNull() & low.isNotNull() & ~F.isnan(low))
               .groupBy(F.col("kind").alias("_k"), bin_of(low).alias("_b"), low.alias("min_depth"))
               .agg(F.max("stamp_id").alias("stamp")))
    entries = entries.groupBy("_k", "_b").agg(F.sort_array(F.collect_list(F.struct("min_depth", "stamp")), asc=False).alias("_own"))
    known = F.col(kind).isNotNull() & row_depth.isNotNull() & ~F.isnan(row_depth)
    rows = projected.withColumn("_b", F.when(known, bin_of(row_depth)))
    wanted = (rows.filter(known).groupBy(F.col(kind).alias("_k"), "_b").agg(F.lit(1).alias("_one")))
    bins = wanted.join(entries, ["_k", "_b"], "full")
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_carry", F.last(F.get("_own", F.lit(0)), ignorenulls=True).over(before))
    bins = bins.filter("_one IS NOT NULL").select(F.col("_k"), F.col("_b").alias("_b2"), "_own", "_carry")
    j = rows.join(bins, (F.col(kind) == F.col("_k")) & (F.col("_b") == F.col("_b2")), "left")
    # thresholds of the bin, the largest first
    own = F.get(F.filter("_own", lambda e: e["min_depth"] < row_depth), F.lit(0))
    best = F.coalesce(own["stamp"], F.col("_carry")["stamp"], F.col(default_col))
    return j.select(*projected.columns, best.cast("int").alias(out))


def column_height(depths: DataFrame, vp: ViewParams = ViewParams()) -> DataFrame:
    """Wall height per column: view_h / (depth * cos(angle - dir)), rounded half even,
    clamped to [0, view_h]; view_h when depth <= 0.  (The cosine is applied again on
    purpose, as in the reference.)"""
    h = F.when(F.col("depth") <= 0, F.lit(vp.view_h)).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(vp.view_h), cell(
            F.lit(vp.view_h) / (F.col("depth") * F.cos(F.col("angle") - F.col("dir")))))))
    return depths.withColumn("height", h.cast("int"))


def depth_band(depth_col="depth", vp: ViewParams = ViewParams()):
    """Four half-open bands of the ray length: <1/4, <2/4, <3/4, rest."""
    L = vp.max_steps * vp.step
    d = F.col(depth_col)
    return (F.when(d < F.lit(L / 4), BAND_GLYPHS[0]).when(d < F.lit(L * 2 / 4), BAND_GLYPHS[1])
            .when(d < F.lit(L * 3 / 4), BAND_GLYPHS[2]).otherwise(BAND_GLYPHS[3]))


def column_raster(heights: DataFrame, vp: ViewParams = ViewParams()) -> DataFrame:
    """(id, x, y, ch): every pixel of every column: sky above (view_h - h) div 2,
    ground from (view_h + h) div 2, wall band between."""
    last = vp.view_h if vp.inclusive_edge else vp.view_h - 1
    px = heights.select("id", F.col("col").alias("x"), "height", "depth",
                        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("y"))
    ch = (F.when(F.col("y") < idiv(F.lit(vp.view_h) - F.col("height"), 2), SKY)
          .when(F.col("y") >= idiv(F.lit(vp.view_h) + F.col("height"), 2), GROUND)
          .otherwise(depth_band("depth", vp)))
    return px.select("id", "x", F.col("y").cast("int").alias("y"), ch.alias("ch"))


def stamp_expand(lod: DataFrame, stamps: DataFrame, pixels: DataFrame,
                 vp: ViewParams = ViewParams(), catalogue_rows: int | None = None) -> DataFrame:
    """Join each projected target to its stamp and the stamp's opaque pixels;
    scale = pf * world size / depth / stamp size.  Transparency is filtered on the
    (small, broadcast) stamp side before the join.  The targets are dealt over tasks before
    they become pixels."""
    pf = vp.projection_factor
    opaque = pixels.filter(F.col("ch").isNotNull() & (F.col("ch") != " "))
    cat = stamps.join(opaque, "stamp_id").withColumnRenamed("stamp_id", "eff_stamp")
    j = dealt(lod, "obs_id", "target_id").join(bounded_broadcast(cat, known_rows=catalogue_rows), "eff_stamp")
    return j.withColumns({
        "scale_x": (F.lit(pf) * F.col("world_w") / F.col("depth")) / F.col("w"),
        "scale_y": (F.lit(pf) * F.col("world_h") / F.col("depth")) / F.col("h"),
    })


def unhidden(lod: DataFrame, stamps: DataFrame, view: DataFrame, vp: ViewParams = ViewParams(),
             catalogue_rows: int | None = None) -> DataFrame:
    """The projected targets that may show a pixel: in front of the occluder of one of the
    columns that their stamp spans at least.  ``view``: rows of ``observer_view``.  A target
    behind a wall is dropped here, as one row, before it becomes its stamp's pixels."""
    s = stamps.select(F.col("stamp_id").alias("_stamp"), F.col("w").alias("_w"))
    j = lod.join(bounded_broadcast(s, known_rows=catalogue_rows), F.col("eff_stamp") == F.col("_stamp"))
    j = j.join(view.select(F.col("id").alias("_id"), F.col("cols.extent").alias("_depths")), F.col("obs_id") == F.col("_id"))
    # as in ``stamp_spans``, a column wider on the right
    scale = (F.lit(vp.projection_factor) * F.col("world_w") / F.col("depth")) / F.col("_w")
    left = F.col("screen_x") - F.rint((F.col("_w") / 2.0) * scale)
    lo = F.greatest(left, F.lit(0)).cast("int")
    hi = F.least(left + F.ceil(F.col("_w") * scale) + 1, F.lit(vp.view_w - 1)).cast("int")
    farthest = F.array_max(F.slice("_depths", lo + 1, hi - lo + 1))
    return j.filter((lo <= hi) & (F.col("depth") < F.when(lo <= hi, farthest))).select(*lod.columns)


def stamp_spans(expanded: DataFrame, vp: ViewParams = ViewParams()) -> DataFrame:
    """Screen span of every texel: anchor = centre - round(size/2 * scale); texel
    [a + floor(s*scale), a + floor((s+1)*scale) - 1], widened to at least one pixel,
    clamped to the screen (a span can end up empty: x0 > x1)."""
    ax = (F.col("screen_x") - F.rint((F.col("w") / 2.0) * F.col("scale_x"))).cast("int")
    ay = (F.col("screen_y") - F.rint((F.col("h") / 2.0) * F.col("scale_y"))).cast("int")
    e = expanded.withColumns({"ax": ax, "ay": ay})
    x0r = (F.col("ax") + F.floor(F.col("sx") * F.col("scale_x"))).cast("int")
    x1r = (F.col("ax") + F.floor((F.col("sx") + 1) * F.col("scale_x")) - 1).cast("int")
    y0r = (F.col("ay") + F.floor(F.col("sy") * F.col("scale_y"))).cast("int")
    y1r = (F.col("ay") + F.floor((F.col("sy") + 1) * F.col("scale_y")) - 1).cast("int")
    e = e.withColumns({"x0r": x0r, "x1r": x1r, "y0r": y0r, "y1r": y1r})
    return e.withColumns({
        "x0": F.greatest(F.col("x0r"), F.lit(0)),
        "x1": F.least(F.greatest(F.col("x1r"), F.col("x0r")), F.lit(vp.view_w - 1)),
        "y0": F.greatest(F.col("y0r"), F.lit(0)),
        "y1": F.least(F.greatest(F.col("y1r"), F.col("y0r")), F.lit(vp.view_h - 1)),
    }).drop("x0r", "x1r", "y0r", "y1r")


def span_pixels(spans: DataFrame, keep=("obs_id", "target_id", "sx", "sy", "ch", "depth")) -> DataFrame:
    """Every pixel of every non-empty span (an empty span gives no rows)."""
    return (spans.select(*keep, "y0", "y1", explode_range("x0", "x1").alias("px"))
            .select(*keep, "px", explode_range("y0", "y1").alias("py")))


def occlude(pixels: DataFrame, extent: DataFrame, vp: ViewParams = ViewParams()) -> DataFrame:
    """Keep a pixel when its depth is in front of the column's occluder depth (of the ray
    length where the column sees no cell)."""
    ext = extent.select(F.col("id").alias("obs_id"), F.col("col").alias("px"), "extent")
    return (pixels.join(ext, ["obs_id", "px"], "left")
            .filter(F.col("depth") < F.coalesce(F.col("extent"), F.lit(vp.ray_length)))
            .drop("extent"))


def nearest_pixel(pixels: DataFrame) -> DataFrame:
    """Closest target pixel per (observer, px, py); ties by (target, sy, sx)."""
    order = F.struct("depth", "target_id", "sy", "sx")
    best = F.min_by(F.struct("ch", "depth", "target_id"), order)
    return (pixels.groupBy(F.col("obs_id").alias("id"), "px", "py").agg(best.alias("b"))
            .select("id", "px", "py", "b.ch", "b.depth", "b.target_id"))


def overlay(base: DataFrame, top: DataFrame) -> DataFrame:
    """Base raster (id, x, y, ch) with top pixels (id, px, py, ch) laid over it."""
    t = top.select("id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("ch").alias("top"))
    return (base.join(t, ["id", "x", "y"], "left")
            .select("id", "x", "y", F.coalesce(F.col("top"), F.col("ch")).alias("ch")))


def raster_rows(cells: DataFrame, key: str = "id", x: str = "x", y: str = "y",
                ch: str = "ch") -> DataFrame:
    """One string per (key, y), characters ordered by x.  A group is one raster row,
    bounded by the view width, not by the data.  No lambdas: the (x, ch) structs
    sort by their natural order and the characters are read off as one field."""
    row = F.array_join(F.sort_array(F.collect_list(F.struct(x, ch)))[ch], "")
    return cells.groupBy(key, y).agg(row.alias("row"))


def observer_view(observers: DataFrame, grid, vp: ViewParams = ViewParams(), seen: bool = False,
                  near: DataFrame | None = None) -> DataFrame:
    """One row per observer: (id, cols): height, glyph and occluder depth by column; and with
    ``seen`` the places of the cells it sees (see ``sight.entry_points``)."""
    rays = sight.ray_summary(observers.select("id", "x", "y", "dir"), grid, vp, places=seen, near=near)
    h = column_height(rays.withColumn("depth", F.coalesce("dist", F.lit(vp.ray_length))), vp)
    one = F.struct("col", "height", depth_band("depth", vp).alias("band"), F.coalesce("extent", F.lit(vp.ray_length)).alias("extent"))
    aggs = [F.sort_array(F.collect_list(one)).alias("cols")]
    if seen:
        aggs.append(F.expr("array_distinct(flatten(collect_list(places))) AS seen"))
    return h.groupBy("id").agg(*aggs)


def top_pixels(nearest: DataFrame) -> DataFrame:
    """(id, top): the nearest target pixels of an observer (at most one per screen cell), by
    screen row."""
    rows = nearest.groupBy("id", "py").agg(F.collect_list(F.struct("px", "ch", "depth")).alias("row"))
    return rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("py", "row"))).alias("top"))


def view_rows(vp: ViewParams = ViewParams(), by_row: bool = False) -> Column:
    """The raster rows of a view (columns cols, top), top to bottom, as an array of strings.
    ``top``: an array of (px, py, ch, depth), or with ``by_row`` the map of ``top_pixels``."""
    last, h = (vp.view_h if vp.inclusive_edge else vp.view_h - 1), vp.view_h
    base = (f"array_join(transform(cols, c -> CASE WHEN y < ({h} - c.height) DIV 2 THEN '{SKY}' "
            f"WHEN y >= ({h} + c.height) DIV 2 THEN '{GROUND}' ELSE c.band END), '')")
    own = "coalesce(top[y], array())" if by_row else "filter(top, p -> p.py = y)"
    patch = f"filter({own}, p -> p.depth < get(cols, p.px).extent)"
    return F.expr(f"transform(sequence(0, {last}), y -> aggregate({patch}, {base}, "
                  "(acc, p) -> overlay(acc PLACING p.ch FROM p.px + 1 FOR 1)))")


def near_icons(observers: DataFrame, mobs: DataFrame, vp: ViewParams = ViewParams()) -> DataFrame:
    """(id, icons): per observer the cells with a mob within reach, as a map from the cell's
    number in the square within reach to the icon; two mobs in one cell give the smallest
    icon, a NULL icon is ?."""
    r = vp.reach
    b = 2 * r + 1
    icons = (mobs.selectExpr("floor(x) AS x", "floor(y) AS y", "coalesce(icon, '?') AS icon")
             .groupBy("x", "y").agg(F.min("icon").alias("icon"))
             .selectExpr("x", "y", "icon", f"floor(x / {b}) AS bx", f"floor(y / {b}) AS by"))
    o = (observers.selectExpr("id", "floor(x) AS ox", "floor(y) AS oy", "explode(array(-1, 0, 1)) AS dx")
         .selectExpr("*", "explode(array(-1, 0, 1)) AS dy")
         .selectExpr("id", "ox", "oy", f"floor(ox / {b}) + dx AS bx", f"floor(oy / {b}) + dy AS by"))
    j = o.join(icons, ["bx", "by"]).filter(f"abs(x - ox) <= {r} AND abs(y - oy) <= {r}")
    return j.groupBy("id").agg(F.expr(f"map_from_entries(collect_list(struct(CAST((y - oy + {r}) * {b} + x - ox + {r} AS INT), icon))) AS icons"))


_SEEN_BITS = 62                    # cells per LONG of the seen plane


def seen_plane(vp: ViewParams = ViewParams()) -> Column:
    """The cells of column ``seen`` (places) as bits, row by row of the square within reach."""
    side = 2 * vp.reach + 1
    n = -(-side // _SEEN_BITS)
    inside = f"filter(seen, p -> p DIV {4 * side} = i DIV {n} AND ((p DIV 4) % {side}) DIV {_SEEN_BITS} = i % {n})"
    return F.expr(f"transform(sequence(0, {side * n - 1}), i -> aggregate({inside}, 0L, "
                  f"(acc, p) -> acc | shiftleft(1L, CAST(((p DIV 4) % {side}) % {_SEEN_BITS} AS INT))))")


def coverage_chars(vp: ViewParams = ViewParams()) -> Column:
    """The (2r+1)^2 window around an observer, row by row, as an array of characters: the
    icon of a mob in a seen cell > seen tile (R shown as .) > remembered wall (floor shown
    blank) > blank.  Needs columns plane (``seen_plane``), icons and those of
    ``sight.neighbourhood``."""
    side = 2 * vp.reach + 1
    n = -(-side // _SEEN_BITS)
    wall = f"{sight.code_at(f'(_x0 + k % {side})', f'(_y0 + k DIV {side})', vp)} = {sight.BLOCKED}"
    seen = (f"shiftrightunsigned(get(plane, CAST((k DIV {side}) * {n} + (k % {side}) DIV {_SEEN_BITS} AS INT)), "
            f"CAST((k % {side}) % {_SEEN_BITS} AS INT)) & 1L = 1L")
    return F.expr(f"transform(sequence(0, {side * side - 1}), k -> CASE WHEN {seen} THEN "
                  f"coalesce(icons[k], CASE WHEN {wall} THEN '#' ELSE '.' END) WHEN {wall} THEN '#' ELSE ' ' END)")


def coverage(observers: DataFrame, grid, mobs: DataFrame, vp: ViewParams = ViewParams()) -> DataFrame:
    """(id, x0, y0, cover, cols): ``cover`` as in ``coverage_chars``, from cell (x0, y0) on;
    ``cols`` as in ``observer_view``."""
    near = sight.neighbourhood(observers, grid, vp)
    v = observer_view(observers, grid, vp, seen=True, near=near)
    v = v.join(near.select("id", "_x0", "_y0", "_near"), "id").join(near_icons(observers, mobs, vp), "id", "left")
    # an inline of one row keeps the plane from being made again per cell
    v = v.select("id", "_x0", "_y0", "_near", "cols", F.expr("coalesce(icons, CAST(map() AS MAP<INT, STRING>)) AS icons"),
                 F.inline(F.array(F.struct(seen_plane(vp).alias("plane")))))
    return v.select("id", F.col("_x0").alias("x0"), F.col("_y0").alias("y0"), coverage_chars(vp).alias("cover"), "cols")


def coverage_rows(vp: ViewParams = ViewParams()) -> Column:
    """The rows of ``cover`` as an array of strings."""
    side = 2 * vp.reach + 1
    return F.expr(f"transform(sequence(0, {side - 1}), y -> array_join(slice(cover, y * {side} + 1, {side}), ''))")


def coverage_map(cover: DataFrame, vp: ViewParams = ViewParams()) -> DataFrame:
    """(id, x, y, ch): the cells of ``coverage``."""
    side = 2 * vp.reach + 1
    return cover.selectExpr("id", "x0", "y0", "posexplode(cover) AS (k, ch)").selectExpr(
        "id", f"x0 + k % {side} AS x", f"y0 + k DIV {side} AS y", "ch")


def coverage_stats(cell_set: DataFrame) -> DataFrame:
    """Per observer: cells seen, blocked cells seen, and seen cells that at least
    one other observer also sees (observers per cell, pre-aggregated per cell).
    The cells are computed once and written, as both counts read them."""
    cell_set = staged(cell_set, "cells-seen")
    per_cell = cell_set.groupBy("tile_x", "tile_y").agg(F.count("*").alias("watchers"))
    return (cell_set.join(per_cell, ["tile_x", "tile_y"])
            .groupBy("id")
            .agg(F.count("*").alias("cells_seen"),
                 F.count_if(F.col("tile") == "#").alias("walls_seen"),
                 F.count_if(F.col("watchers") >= 2).alias("shared_cells")))


def coverage_bitmaps(cell_set: DataFrame, width: int) -> DataFrame:
    """(id, block, bits): the cells an observer sees, a bitmap of 32,768 cells a block.  Cells
    are numbered row by row, so what is near lies in one or two blocks."""
    number = F.col("tile_y") * F.lit(width).cast("long") + F.col("tile_x")
    return (cell_set.groupBy("id", F.bitmap_bucket_number(number).alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")))


def coverage_rollup(bitmaps: DataFrame, teams: DataFrame) -> DataFrame:
    """(level, team, id, cells_seen): cells seen by every observer, by all observers of a team
    together, and by all of the world; ``teams``: (id, team), a NULL team is one.

    Each level is the union of the bitmaps of the one below (``bitmap_or_agg``, reduced in
    every task before the exchange), so no cell row is counted distinct again and the march
    that made the bitmaps runs once for all three."""
    t = teams.select(F.col("id").alias("t_id"), "team")
    b = bitmaps.join(t, F.col("id") == F.col("t_id"), "left").select("id", "team", "block", "bits")
    sets = b.groupingSets([("block", "team", "id"), ("block", "team"), ("block",)], "block", "team", "id")
    level = F.when(F.grouping_id() == 0, "observer").when(F.grouping_id() == 1, "team").otherwise("world")
    united = sets.agg(level.alias("level"), F.bitmap_or_agg("bits").alias("bits"))
    return (united.groupBy("level", "team", "id").agg(F.sum(F.bitmap_count("bits")).alias("cells_seen")))
