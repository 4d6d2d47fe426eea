"""L - line of sight from many observers over a blocked grid.

Rays: one per screen column; a ray advances ``step`` per march row up to
``max_steps`` rows and stops *after* the first row that lands in a blocking cell
(that row is kept).  Positions use the closed form ``p + n * (step * cos(angle))``
instead of repeated addition (a documented deviation: identical cells except on exact
.5 ties).  ``dist`` of row n is ``(n - 1) * step * cos(angle - dir)``, i.e. already
fish-eye corrected.  Off-grid points never stop a ray.

Plan notes: ``neighbourhood`` joins each observer once to the packed grid rows within
reach and keeps them on the observer as a short array of two bits per cell, whose
length follows from the view.  Its one exchange is by observer id; the fan, the march, the
stop at the first wall and every aggregate per ray or observer then stay in the same
partition, and a cell's tile is a bit test.  No step or cell row is ever shuffled and
the plan does not change with the size of the world.  ``ray_march`` also takes a long
(x, y, tile) grid and joins it by cell: that is the definition the tests compare with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import by_merge
from tessera.operators.raster import PackedGrid
from tessera.params import ViewParams

WALL = "#"
#: Two bits per cell near an observer.
OFF, BLOCKED, OPEN, MARKED = 0, 1, 2, 3
_CELLS = 31                        # per LONG (its sign bit stays clear)
_NEAR = ("_x0", "_y0", "_near")


def longs_per_row(vp: ViewParams) -> int:
    return -(-(2 * vp.reach + 1) // _CELLS)


def neighbourhood(observers: DataFrame, grid: PackedGrid, vp: ViewParams = ViewParams(),
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Observers (id, x, y, dir, *keep) with the grid within reach: the first cell (_x0, _y0)
    and ``_near``, an array with two bits per cell, row by row: no cell, blocked, open, or
    of the grid's first layer.  ``id`` is unique."""
    r, word = vp.reach, PackedGrid.WORD
    side, nw, n = 2 * r + 1, (2 * r) // word + 2, longs_per_row(vp)
    cols = ["x", "y", "dir", *keep]
    slots = observers.selectExpr("id", *cols, f"floor(x) - {r} AS _x0", f"floor(y) - {r} AS _y0",
                                 f"explode(sequence(0, {side * nw - 1})) AS _i")
    slots = slots.selectExpr("*", f"_y0 + _i div {nw} AS _gy", f"floor(_x0 / {word}) + _i % {nw} AS _gw")
    masks = grid.masks.selectExpr("y AS _my", "w AS _mw", *[f"m{i}" for i in range(len(grid.tiles))])
    j = slots.join(by_merge(masks), F.expr("_gy = _my AND _gw = _mw"), "left")
    # per word: cells that exist (none past the width), open cells, cells of the first layer
    free = " | ".join(["0L", *[f"coalesce(m{i}, 0L)" for i, t in enumerate(grid.tiles) if t != WALL]])
    tail = f"WHEN _mw = {grid.width // word} THEN {(1 << grid.width % word) - 1}L" if grid.width % word else ""
    j = j.selectExpr("id", *cols, "_x0", "_y0", "_i", f"CASE WHEN _my IS NULL THEN 0L {tail} ELSE -1L END AS _o",
                     f"{free} AS _f", "coalesce(m0, 0L) AS _m")
    out = j.groupBy("id").agg(*[F.expr(f"first({c}) AS {c}") for c in (*cols, "_x0", "_y0")],
                              F.expr("sort_array(collect_list(struct(_i, _o, _f, _m))) AS _a"))
    # an inline of one row keeps the words of an observer from being read again per cell
    out = out.selectExpr("id", *cols, "_x0", "_y0", f"inline(array(struct(CAST(pmod(_x0, {word}) AS INT) AS _s, "
                         "_a._o AS _o, _a._f AS _f, _a._m AS _m)))")

    def bit(words, row, dx):
        return (f"(shiftrightunsigned(get({words}, CAST({row} * {nw} + (_s + {dx}) DIV {word} AS INT)), "
                f"CAST((_s + {dx}) % {word} AS INT)) & 1L)")
    row, dx = f"(i DIV {n})", f"((i % {n}) * {_CELLS} + k)"
    code = (f"CASE WHEN {bit('_o', row, dx)} = 0 THEN {OFF}L WHEN {bit('_f', row, dx)} = 0 THEN {BLOCKED}L "
            f"ELSE {OPEN}L + {bit('_m', row, dx)} END")
    # the i-th LONG: up to 31 cells of one row
    near = (f"transform(sequence(0, {side * n - 1}), i -> aggregate(sequence(0, least({_CELLS - 1}, {side - 1} - (i % {n}) * {_CELLS})), "
            f"0L, (acc, k) -> acc | shiftleft({code}, 2 * k)))")
    return out.selectExpr("id", *cols, "_x0", "_y0", f"{near} AS _near")


def code_at(x: str, y: str, vp: ViewParams = ViewParams()) -> str:
    """SQL for the two bits of cell (x, y), which lies within reach of the observer."""
    n = longs_per_row(vp)
    if n == 1:
        return f"(shiftrightunsigned(get(_near, CAST({y} - _y0 AS INT)), CAST(2 * ({x} - _x0) AS INT)) & 3L)"
    return (f"(shiftrightunsigned(get(_near, CAST(({y} - _y0) * {n} + ({x} - _x0) DIV {_CELLS} AS INT)), "
            f"CAST(2 * (({x} - _x0) % {_CELLS}) AS INT)) & 3L)")


def ray_fan(observers: DataFrame, vp: ViewParams = ViewParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, x, y, dir, *keep, col, angle): angle = dir - fov/2 + fov * col / (view_w - 1)."""
    last = vp.view_w if vp.inclusive_edge else vp.view_w - 1
    rays = observers.select("id", "x", "y", "dir", *keep,
                            F.explode(F.sequence(F.lit(0), F.lit(last))).alias("col"))
    return rays.withColumn(
        "angle", F.col("dir") - F.lit(vp.fov / 2.0)
        + F.lit(vp.fov) * (F.col("col").cast("double") / F.lit(float(vp.view_w - 1))))


def march_points(rays: DataFrame, vp: ViewParams = ViewParams(), keep: tuple[str, ...] = (), stop: bool = False) -> DataFrame:
    """Every candidate march row n = 1..max_steps of every ray (no stopping yet).  ``stop``: only
    up to the first blocked cell, which each ray with the columns of ``neighbourhood`` finds in
    its own row, so no march row is sorted or moved.

    ``entry`` marks the first row of the ray in its cell (n = 1, or row n - 1, in the
    same closed form, lies in another cell).  The samples of a straight ray that
    round to one cell are contiguous in n (a cell is convex and the rounding is
    monotone), and ``dist`` grows with n, so the entry row of a cell carries the
    cell's smallest distance and the first blocking row is always an entry row."""
    # the step of a ray is computed once per ray, below the explode
    pts = rays.selectExpr("id", "col", "angle", "dir", "x", "y", *keep, f"{vp.step!r}D * cos(angle) AS _dx",
                          f"{vp.step!r}D * sin(angle) AS _dy", "cos(angle - dir) AS _c")
    last = f"{vp.max_steps}"
    if stop:
        code = code_at("CAST(rint(x + i * _dx) AS BIGINT)", "CAST(rint(y + i * _dy) AS BIGINT)", vp)
        last = f"coalesce(array_min(filter(sequence(1, {vp.max_steps}), i -> {code} = {BLOCKED})), {vp.max_steps})"
    pts = pts.selectExpr("*", f"explode(sequence(1, {last})) AS n")
    pts = pts.selectExpr("id", "col", "angle", "dir", *keep, "n", "CAST(rint(x + n * _dx) AS BIGINT) AS cx",
                         "CAST(rint(y + n * _dy) AS BIGINT) AS cy", "CAST(rint(x + (n - 1) * _dx) AS BIGINT) AS _px",
                         "CAST(rint(y + (n - 1) * _dy) AS BIGINT) AS _py", f"(n - 1) * {vp.step!r}D * _c AS dist")
    return pts.selectExpr("id", "col", "angle", "dir", *keep, "n", "cx", "cy", "dist",
                          "n = 1 OR cx <> _px OR cy <> _py AS entry")


def with_tiles(pts: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds ``tile`` (NULL off the grid) to points with cell columns (cx, cy)."""
    return pts.join(grid.select(F.col("x").alias("cx"), F.col("y").alias("cy"), "tile"), ["cx", "cy"], "left")


def _near_rays(observers: DataFrame, grid: PackedGrid, vp: ViewParams) -> DataFrame:
    return ray_fan(neighbourhood(observers, grid, vp), vp, keep=_NEAR)


def _tile(grid: PackedGrid, code: str = "_code") -> Column:
    """The tile of a cell code (of a grid of two layers at most)."""
    free = grid.tiles[1] if len(grid.tiles) > 1 else grid.tiles[0]
    return F.expr(f"CASE {code} WHEN {BLOCKED} THEN '{WALL}' WHEN {MARKED} THEN '{grid.tiles[0]}' WHEN {OPEN} THEN '{free}' END")


def entry_points(observers: DataFrame, grid: PackedGrid, vp: ViewParams = ViewParams(), near: DataFrame | None = None,
                 stop: bool = False) -> DataFrame:
    """The entry rows of the march (about one row per cell crossed) with their tile and
    ``place``: four times the cell's number in the square of cells within reach (row by row
    from (_x0, _y0) on) plus its code.  ``near``: the observers' neighbourhood, if it is at
    hand; ``stop``: as in ``march_points``."""
    near = neighbourhood(observers, grid, vp) if near is None else near
    pts = march_points(ray_fan(near, vp, keep=_NEAR), vp, keep=_NEAR, stop=stop).filter("entry")
    pts = pts.selectExpr("id", "col", "angle", "dir", "n", "cx", "cy", "dist", "_x0", "_y0", f"{code_at('cx', 'cy', vp)} AS _code")
    return pts.withColumns({"tile": _tile(grid), "place": F.expr(
        f"CAST(((cy - _y0) * {2 * vp.reach + 1} + cx - _x0) * 4 + _code AS INT)")}).drop("_code")


def ray_march(observers: DataFrame, grid, vp: ViewParams = ViewParams()) -> DataFrame:
    """(id, col, n, cx, cy, dist, tile): the march rows each ray really visits;
    ``tile`` is NULL off the grid.  ``grid``: packed, or long (x, y, tile)."""
    cols = ["id", "col", "n", "cx", "cy", "dist", "tile"]
    if isinstance(grid, PackedGrid):
        pts = march_points(_near_rays(observers, grid, vp), vp, keep=_NEAR, stop=True)
        return pts.withColumn("_code", F.expr(code_at("cx", "cy", vp))).withColumn("tile", _tile(grid)).select(*cols)
    return _stop_at_first_wall(with_tiles(march_points(ray_fan(observers, vp), vp), grid).select(*cols))


def _stop_at_first_wall(pts: DataFrame) -> DataFrame:
    ray = Window.partitionBy("id", "col")
    h = F.min(F.when(F.col("tile") == WALL, F.col("n"))).over(ray)
    return (pts.withColumn("h", h)
            .filter(F.col("h").isNull() | (F.col("n") <= F.col("h")))
            .drop("h"))


def visible_cells(march: DataFrame) -> DataFrame:
    """(id, col, tile_x, tile_y, tile, dist): marched rows on the grid, nearest entry
    per (observer, column, cell).  The definition; ``visible_entries`` is the same
    table computed from entry rows only."""
    return (march.filter(F.col("tile").isNotNull())
            .groupBy("id", "col", F.col("cx").alias("tile_x"), F.col("cy").alias("tile_y"), "tile")
            .agg(F.min("dist").alias("dist")))


def visible_entries(observers: DataFrame, grid: PackedGrid, vp: ViewParams = ViewParams()) -> DataFrame:
    """``visible_cells(ray_march(observers, grid))`` without the full march: each visited
    cell is its entry row (which holds the cell's smallest distance), and each
    ray ends at its first wall by itself, so no window and no aggregate is needed."""
    vis = entry_points(observers, grid, vp, stop=True).filter(F.col("tile").isNotNull())
    return vis.select("id", "col", F.col("cx").alias("tile_x"), F.col("cy").alias("tile_y"), "tile", "dist")


def ray_summary(observers: DataFrame, grid: PackedGrid, vp: ViewParams = ViewParams(), places: bool = False,
                near: DataFrame | None = None) -> DataFrame:
    """One row per ray from one march: id, col, angle, dir, n and dist of the first blocking
    row (NULL without a hit), extent (the farthest visible entry, NULL if none), and with
    ``places`` the visible cells as an array (see ``entry_points``) and its origin _x0, _y0.

    The march never passes its first wall, so the hit is the smallest blocked n; ``dist``
    grows with n (needs fov < pi), so the extent is the hit, or else the last cell."""
    assert vp.fov < 3.141592653589793
    e = entry_points(observers, grid, vp, near).filter("tile IS NOT NULL OR n = 1")
    aggs = ["first(angle) AS angle", "first(dir) AS dir", f"min(CASE WHEN tile = '{WALL}' THEN n END) AS n",
            f"min(CASE WHEN tile = '{WALL}' THEN dist END) AS dist", "max(CASE WHEN tile IS NOT NULL THEN dist END) AS _far"]
    if places:
        aggs += ["collect_list(CASE WHEN tile IS NOT NULL THEN struct(n AS s, place) END) AS _p", "first(_x0) AS _x0", "first(_y0) AS _y0"]
    out = ["id", "col", "angle", "dir", "n", "dist", "coalesce(dist, _far) AS extent"]
    if places:
        out += ["transform(filter(_p, p -> n IS NULL OR p.s <= n), p -> p.place) AS places", "_x0", "_y0"]
    return e.groupBy("id", "col").agg(*map(F.expr, aggs)).selectExpr(*out)


def first_hit(observers: DataFrame, grid: PackedGrid, vp: ViewParams = ViewParams()) -> DataFrame:
    """(id, col, n, dist): nearest blocking march row per ray; rays without a hit are
    absent."""
    assert vp.fov < 3.141592653589793
    pts = march_points(_near_rays(observers, grid, vp), vp, keep=_NEAR)
    walls = pts.filter(f"entry AND {code_at('cx', 'cy', vp)} = {BLOCKED}")
    return walls.groupBy("id", "col").agg(F.min("n").alias("n"), F.min("dist").alias("dist"))


def ray_depth(rays: DataFrame, vp: ViewParams = ViewParams()) -> DataFrame:
    """(id, col, angle, dir, depth) of ``ray_summary`` rows: hit distance, or
    max_steps*step (not cos-corrected) for a ray without a hit."""
    return rays.select("id", "col", "angle", "dir", F.coalesce(F.col("dist"), F.lit(vp.max_steps * vp.step)).alias("depth"))


def ray_extent(rays: DataFrame) -> DataFrame:
    """(id, col, extent): the farthest visible cell entry of a ray (occluder depth)."""
    return rays.filter("extent is not null").select("id", "col", "extent")


def visible_cell_set(observers: DataFrame, grid: PackedGrid, vp: ViewParams = ViewParams()) -> DataFrame:
    """(id, tile_x, tile_y, tile): cells an observer sees over all its rays: the distinct
    places of its rays, gathered on the observer's row."""
    side = 2 * vp.reach + 1
    seen = (ray_summary(observers, grid, vp, places=True).groupBy("id")
            .agg(F.expr("first(_x0) AS _x0"), F.expr("first(_y0) AS _y0"), F.expr("array_distinct(flatten(collect_list(places))) AS seen")))
    cells = seen.selectExpr("id", "_x0", "_y0", "explode(seen) AS p").selectExpr(
        "id", f"_x0 + (p DIV 4) % {side} AS tile_x", f"_y0 + p DIV {4 * side} AS tile_y", "p % 4 AS _code")
    return cells.select("id", "tile_x", "tile_y", _tile(grid).alias("tile"))
