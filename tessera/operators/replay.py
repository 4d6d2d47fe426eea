"""Replay of an action log against walls, many steps per key.

A move that would end off the grid or in a blocked cell is cancelled; the next ones start
from where the key stands.  The direction depends on the turns alone, so every step's
vector, and their running sum over a key's log, are known before any wall is.  While
nothing is cancelled a key's position is an offset plus that sum.

One round takes every unfinished key

* along the free run: all its remaining steps are placed at once by the running sums and
  looked up in the packed grid; the first cancelled one ends the run (a partial minimum);
* through what follows: the next ``window`` steps are folded in order with the cells within
  ``reach`` of the key, two bits each, until the key leaves them;
* and, if it then stands at a wall, along the stuck run: every further step is tested from
  the same place with the nine cells around it, the first possible one ends the run.

So a key that walks freely, or pushes at a wall, for any number of steps is done in one round,
one that bounces off walls advances by ``window`` steps a round, and no task holds more
than ``window`` rows of a key.  The rows of a round that are decided are written; only the
rest goes on.  Positions are whole numbers of 1e-9, so the sums are exact however they are
split.

NULL keys are one key; NULL times come first; actions other than moves and turns leave the
key where it stands.  (ts, seq) is unique within a key.  A key without a start begins at
the spawn point.  An empty log gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.joins import by_merge
from tessera.functions.num import cell, epoch_micros
from tessera.functions.ranking import add_prefix_sums, with_bucket
from tessera.operators import sight
from tessera.operators.raster import PackedGrid
from tessera.operators.state import FIXED_POINT
from tessera.params import StateParams, ViewParams
from tessera.session import staged

_ONE = float(FIXED_POINT)
_REST = ["_k", "_b", "key", "ts", "seq", "action", "dir", "i", "gx", "gy", "vx", "vy", "is_move"]
_OUT = ["key", "ts", "seq", "action", "dir", "px", "py", "moved"]


def _steps(starts: DataFrame, actions: DataFrame, sp: StateParams, bucket_s: int) -> DataFrame:
    """Every action with its number i in the key's log, its step (vx, vy), the running sums
    (gx, gy) of the steps up to and with it, and the key's start (x0, y0)."""
    st = starts.select(F.col("id").alias("_id"), *[F.col(c).alias(f"{c}0") for c in ("x", "y", "dir")])
    a = actions.select("key", "ts", "seq", "action").join(st, F.col("key") == F.col("_id"), "left").select(
        "key", "ts", "seq", "action",
        *[F.coalesce(f"{c}0", F.lit(v)).alias(f"{c}0") for c, v in (("x", sp.spawn_x), ("y", sp.spawn_y), ("dir", sp.spawn_dir))])
    a = with_bucket(a, "key", F.floor(epoch_micros("ts") / (bucket_s * 1_000_000)))
    turn = F.when(F.col("action") == "d", 1).when(F.col("action") == "a", -1).otherwise(0).cast("long")
    t = add_prefix_sums(a, ["ts", "seq"], {"net_turn": turn, "i": F.lit(1).cast("long")})
    t = t.withColumn("dir", F.col("dir0") + F.col("net_turn") * F.lit(sp.turn_speed))
    sign = F.when(F.col("action") == "w", 1.0).when(F.col("action") == "s", -1.0).otherwise(0.0)
    t = t.withColumns({"vx": F.round(sign * F.cos("dir") * F.lit(sp.move_speed) * FIXED_POINT).cast("long"),
                       "vy": F.round(sign * F.sin("dir") * F.lit(sp.move_speed) * FIXED_POINT).cast("long"),
                       "is_move": F.coalesce(F.col("action").isin("w", "s"), F.lit(False))})
    return add_prefix_sums(t, ["ts", "seq"], {"gx": F.col("vx"), "gy": F.col("vy")})


def _fixed(c: str) -> Column:
    return F.round(F.col(c) * FIXED_POINT).cast("long")


def _cell(fixed: Column) -> Column:
    return cell(fixed / F.lit(_ONE))


def _free(tile: Column) -> Column:
    return tile.isNotNull() & (tile != sight.WALL)


def _by_key(rows: DataFrame, keys: DataFrame, how: str = "left") -> DataFrame:
    """Rows with the columns of their key (``_k`` is a struct, which holds NULL equal to NULL)."""
    return rows.join(keys.withColumnRenamed("_k", "_kk"), F.col("_k") == F.col("_kk"), how).drop("_kk")


def _window_fold(reach: int, longs: int, half: int):
    """The window of a key, in order, with the cells within ``reach``.  Gives the place after
    each step until a step would leave those cells, and the state after the last of them."""
    def code(near, x0, y0, cx, cy):
        dx, dy = cx - x0, cy - y0
        word = near[dy * longs + dx // sight._CELLS]
        return word >> 2 * (dx % sight._CELLS) & 3

    def nearest(v):                    # half even, as a cell is rounded
        return round(v / _ONE)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(j)[r].as_py() for j, n in enumerate(b.schema.names)}
                x, y, near = row["px"], row["py"], row["_near"]
                done, stuck = [], False
                for s in row["steps"]:
                    ok = None
                    if s["is_move"]:
                        tx, ty = x + s["vx"], y + s["vy"]
                        cx, cy = nearest(tx), nearest(ty)
                        if abs(cx - row["_x0"] - reach) > half or abs(cy - row["_y0"] - reach) > half:
                            break
                        ok = code(near, row["_x0"], row["_y0"], cx, cy) >= sight.OPEN
                        stuck = not ok
                        if ok:
                            x, y = tx, ty
                    done.append((s["i"], x, y, ok, s["gx"], s["gy"]))
                last = done[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["_k"]], b.schema.field("_k").type), pa.array([last[0]], pa.int64()), pa.array([x], pa.int64()),
                     pa.array([y], pa.int64()), pa.array([last[4]], pa.int64()), pa.array([last[5]], pa.int64()), pa.array([stuck]),
                     pa.array([[dict(zip(("i", "px", "py", "moved"), d)) for d in done]],
                              pa.list_(pa.struct([("i", pa.int64()), ("px", pa.int64()), ("py", pa.int64()), ("moved", pa.bool_())])))],
                    ["_k", "e", "ex", "ey", "egx", "egy", "stuck", "done"])
    return run


def replay(starts: DataFrame, actions: DataFrame, grid: PackedGrid, sp: StateParams = StateParams(), window: int = 1024,
           reach: int = 48, bucket_s: int = 3600) -> tuple[DataFrame, int]:
    """((key, ts, seq, action, dir, x, y, moved), rounds): where each action of the log leaves
    its key; ``moved`` is NULL for what is no move.

    Runs when it is called: the driver reads one count per round."""
    assert window >= 1 and reach >= math.ceil(sp.move_speed) + 2
    steps = staged(_steps(starts, actions, sp, bucket_s), "replay-steps")
    front = (steps.groupBy("_k").agg(F.first("x0").alias("x0"), F.first("y0").alias("y0"))
             .select("_k", _fixed("x0").alias("ox"), _fixed("y0").alias("oy")))
    rest, out, rounds = steps.select(*_REST), None, 0
    while rest is not None:
        decided, rest, front = _round(rest, front, grid, sp, window, reach, rounds)
        out = decided if out is None else out.unionByName(decided)
        rounds += 1
    return out.select("key", "ts", "seq", "action", "dir", (F.col("px") / F.lit(_ONE)).alias("x"),
                      (F.col("py") / F.lit(_ONE)).alias("y"), "moved"), rounds


def _round(rest, front, grid, sp, window, reach, number):
    """(rows decided in this round, the other rows or None, where their keys stand)."""
    # the free run
    p = _by_key(rest, front, "inner").withColumns({"px": F.col("ox") + F.col("gx"), "py": F.col("oy") + F.col("gy")})
    p = grid.lookup(p.withColumns({"cx": _cell(F.col("px")), "cy": _cell(F.col("py"))}))
    p = staged(p.select(*_REST, "px", "py", (F.col("is_move") & ~_free(F.col("tile"))).alias("bad")), f"replay-{number}-probed")
    at = F.struct("i", (F.col("px") - F.col("vx")).alias("px"), (F.col("py") - F.col("vy")).alias("py"))
    first = p.filter("bad").groupBy("_k").agg(F.min(at).alias("m")).select("_k", F.col("m.i").alias("r"), "m.px", "m.py")
    first = staged(first, f"replay-{number}-walls")
    moved = F.when(F.col("is_move"), F.lit(True)).alias("moved")
    if first.isEmpty():
        return p.select(*_OUT[:-1], moved), None, None
    q = _by_key(p, first.select("_k", "r"))
    free = q.filter("r IS NULL OR i < r").select(*_OUT[:-1], moved)

    # the window behind the first cancelled step
    box = ViewParams(step=1.0, max_steps=reach - 1)
    standing = first.select(F.struct("_k", "r", "px", "py").alias("id"), (F.col("px") / F.lit(_ONE)).alias("x"),
                            (F.col("py") / F.lit(_ONE)).alias("y"), F.lit(0.0).alias("dir"))
    near = sight.neighbourhood(standing, grid, box).select("id._k", "id.r", "id.px", "id.py", "_x0", "_y0", "_near")
    one = F.struct("i", "vx", "vy", "is_move", "gx", "gy")
    next_ = (q.filter(f"i >= r AND i < r + {window}").groupBy("_k").agg(F.sort_array(F.collect_list(one)).alias("steps")))
    k_type = first.schema["_k"].dataType.simpleString()
    folded = _by_key(next_, by_merge(near), "inner").select("_k", "px", "py", "_x0", "_y0", "_near", "steps").mapInArrow(
        _window_fold(reach, sight.longs_per_row(box), reach - 1),
        f"_k {k_type}, e long, ex long, ey long, egx long, egy long, stuck boolean, "
        "done array<struct<i:long,px:long,py:long,moved:boolean>>")
    folded = staged(folded, f"replay-{number}-folded")
    walked = folded.select("_k", F.inline("done")).withColumnsRenamed({"_k": "w_k", "i": "w_i"})
    walked = (p.select("_k", "i", "key", "ts", "seq", "action", "dir")
              .join(by_merge(walked), (F.col("_k") == F.col("w_k")) & (F.col("i") == F.col("w_i"))).select(*_OUT))

    # the stuck run: the nine cells around the place
    state = folded.select("_k", "e", "ex", "ey", "egx", "egy", "stuck")
    place = state.filter("stuck").select("_k", "ex", "ey", _cell(F.col("ex")).alias("hx"), _cell(F.col("ey")).alias("hy"))
    step = math.ceil(sp.move_speed) + 1
    span = F.sequence(F.lit(-step), F.lit(step))
    around = (place.select("_k", "hx", "hy", F.explode(span).alias("dx")).select("*", F.explode(span).alias("dy"))
              .withColumns({"cx": F.col("hx") + F.col("dx"), "cy": F.col("hy") + F.col("dy")}))
    open_ = (grid.lookup(around).filter(_free(F.col("tile"))).groupBy("_k")
             .agg(F.collect_list(F.struct(F.col("cx"), F.col("cy"))).alias("open")))
    behind = _by_key(p.filter("is_move"), state.filter("stuck"), "inner").filter("i > e")
    behind = _by_key(behind, open_)
    target = F.struct(_cell(F.col("ex") + F.col("vx")).alias("cx"), _cell(F.col("ey") + F.col("vy")).alias("cy"))
    can = F.coalesce(F.array_contains("open", target), F.lit(False))
    go = F.struct("i", (F.col("gx") - F.col("vx")).alias("gx"), (F.col("gy") - F.col("vy")).alias("gy"))
    freed = behind.filter(can).groupBy("_k").agg(F.min(go).alias("f"))
    state = staged(_by_key(state, freed), f"replay-{number}-state")
    s = _by_key(p, state, "inner").filter("i > e")
    held = "stuck AND (f IS NULL OR i < f.i)"
    stood = s.filter(held).select("key", "ts", "seq", "action", "dir", F.col("ex").alias("px"), F.col("ey").alias("py"),
                                  F.when(F.col("is_move"), F.lit(False)).alias("moved"))
    left = staged(s.filter(f"NOT ({held})").select(*_REST), f"replay-{number}-rest")
    front = state.select("_k", (F.col("ex") - F.coalesce("f.gx", "egx")).alias("ox"), (F.col("ey") - F.coalesce("f.gy", "egy")).alias("oy"))
    decided = free.unionByName(walked).unionByName(stood)
    return decided, (None if left.isEmpty() else left), front
