"""Replay of action logs against walls, against a sequential fold per key."""

import datetime as dt
import math
import random

import pytest

from tessera.operators import replay
from tessera.operators.raster import PackedGrid
from tessera.params import StateParams

SP = StateParams()
T0 = dt.datetime(2024, 1, 1)
ONE = 1_000_000_000


def grid_of(spark, open_cells, width, rows):
    cells = spark.createDataFrame(sorted(open_cells) or [(-1, -1)], "x long, y long")
    return PackedGrid.from_layers([(cells, "R"), (cells, ".")], width, spark.range(rows).selectExpr("id AS y"))


def fold(starts, actions, open_cells):
    """{(key, seq): (x, y, moved)}, one action after the other."""
    out = {}
    state = {i: [round(x * ONE), round(y * ONE), d, 0] for i, x, y, d in starts}
    for key, ts, seq, act in sorted(actions, key=lambda a: (a[0] is not None, a[0] or 0, a[1] is not None, a[1] or T0, a[2])):
        s = state.setdefault(key, [round(SP.spawn_x * ONE), round(SP.spawn_y * ONE), SP.spawn_dir, 0])
        s[3] += {"d": 1, "a": -1}.get(act, 0)
        moved = None
        if act in ("w", "s"):
            sign, d = 1.0 if act == "w" else -1.0, s[2] + s[3] * SP.turn_speed
            # Spark rounds half up; no step of these tests ends on a half
            x, y = (p + round(sign * f(d) * SP.move_speed * ONE) for p, f in zip(s, (math.cos, math.sin)))
            moved = (round(x / ONE), round(y / ONE)) in open_cells
            if moved:
                s[0], s[1] = x, y
        out[key, seq] = (s[0] / ONE, s[1] / ONE, moved)
    return out


def check(spark, starts, actions, open_cells, width=64, rows=64, **kw):
    s = spark.createDataFrame(starts or [(-1, 0.0, 0.0, 0.0)], "id long, x double, y double, dir double")
    a = spark.createDataFrame(actions, "key long, ts timestamp_ntz, seq long, action string").repartition(3)
    out, rounds = replay.replay(s, a, grid_of(spark, open_cells, width, rows), SP, **kw)
    got = {(r.key, r.seq): (r.x, r.y, r.moved) for r in out.collect()}
    want = fold(starts, actions, open_cells)
    assert got.keys() == want.keys()
    for k, (x, y, m) in want.items():
        assert got[k][2] == m and got[k][:2] == pytest.approx((x, y), abs=1e-7), k
    return rounds


def log(key, acts, start=0):
    return [(key, T0 + dt.timedelta(seconds=start + i // 3), start + i, a) for i, a in enumerate(acts)]


ROOM = {(x, y) for x in range(2, 20) for y in range(2, 14)}


@pytest.mark.parametrize("window,reach", [(1024, 48), (7, 4), (1, 3)])
def test_random_logs_equal_a_fold(spark, window, reach):
    """Several keys in a room with pillars; NULL key and times, actions that are no moves, a key
    without a start, a hot key."""
    rnd = random.Random(5)
    cells = ROOM - {(x, y) for x in range(5, 18, 4) for y in range(4, 12, 3)}
    starts = [(k, 3 + k * 0.137, 3 + k * 0.211, k * 0.713) for k in range(4)]
    acts = [a for k in range(4) for a in log(k, rnd.choices("wwwwsadx", k=40 if window < 9 else 120 + 500 * (k == 0)))]
    acts += log(None, rnd.choices("wwsad", k=20)) + log(77, rnd.choices("wwad", k=20))
    acts += [(2, None, 10_000 + i, a) for i, a in enumerate("wwds")] + [(2, T0, 20_000, None)]
    check(spark, starts, acts, cells, window=window, reach=reach)


def test_a_run_of_ten_thousand_cancelled_steps_is_one_round(spark):
    acts = log(1, ["w"] * 10_060 + ["d"] * 5 + ["w"] * 10_000 + ["s"] * 30 + ["x"])
    rounds = check(spark, [(1, 18.0, 7.0, 0.1)], acts, ROOM, window=64)
    assert rounds <= 4


def test_a_long_free_run_is_one_round(spark):
    rounds = check(spark, [(1, 3.0, 7.1, 0.0)], log(1, ["w"] * 5 + ["w", "s"] * 5000), ROOM, window=8)
    assert rounds == 1


def test_bouncing_advances_by_a_window_a_round(spark):
    """Back and forth between wall and room: accepted and cancelled steps take turns."""
    acts = log(1, ["w"] * 10 + ["w", "w", "s"] * 1000)
    rounds = check(spark, [(1, 18.0, 7.0, 0.0)], acts, ROOM, window=512)
    assert rounds <= 2 + 3010 // 512 + 1


def test_walled_in_off_the_grid_and_empty(spark):
    acts = log(1, "wwdws") + log(2, "wsx") + log(3, "")
    assert check(spark, [(1, 30.0, 30.0, 0.3), (2, -50.0, 1000.0, 0.0)], acts, ROOM) == 1
    empty = spark.createDataFrame([], "key long, ts timestamp_ntz, seq long, action string")
    starts = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, dir double")
    out, rounds = replay.replay(starts, empty, grid_of(spark, ROOM, 64, 64), SP)
    assert out.count() == 0 and rounds == 1


def test_leaving_the_cells_at_hand(spark):
    """A key that hits a wall and then walks far off within one window."""
    cells = {(x, 5) for x in range(0, 400)}
    acts = log(1, "s" * 3 + "w" * 900 + "s" * 40)
    check(spark, [(1, 1.0, 5.0, 0.0)], acts, cells, width=400, rows=12, window=1024, reach=5)
