"""What a task holds does not grow with the rows it reads: counts of rows and plans that tell."""

import contextlib
import datetime as dt
import io
import os
import re
import tempfile

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.operators import camera, raster, replay, sight, spatial, state
from tessera.sources.world import World
from tessera.streaming import jobs, keys
from tests.conftest import SF_SMALL
from tests.test_stream_keys import EVENTS, T0, at, naive_release, write_files


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_release_calls_python_for_buckets_not_keys(spark):
    """300 keys in 4 buckets: four states at most, the same intervals; NULL and huge keys."""
    rows = [(k if k else None, at(s + k % 7), k * 10 + s, "click") for k in range(300) for s in (0, 5, 40)]
    rows += [(2 ** 60 + 1, at(1), 9001, "view"), (2 ** 60 + 2, at(2), 9002, "view")]
    d = write_files(spark, [rows, [(1, at(5000), 9003, "click")]], EVENTS)
    progress = []
    acts = jobs.action_stream(spark, d, table="events-*", max_files_per_trigger=1)
    out = jobs.run_to_parquet(keys.release_intervals(acts, 10_000_000, "60 seconds", buckets=4), "t-buckets", progress=progress)
    e0 = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    got = sorted(((r.key or 0), r.action, r.pressed // 1_000_000 - e0, r.released // 1_000_000 - e0, r.presses) for r in out.collect())
    letter = {"click": "w", "view": "s"}
    naive = naive_release([(k, letter[e], int((t - T0).total_seconds())) for k, t, _, e in rows], 10, 4940)
    assert got == sorted((k or 0, *rest) for (k, *rest), n in naive.items() for _ in range(n))
    assert max(o["numRowsTotal"] for p in progress for o in p["stateOperators"]) <= 4


def test_merge_presses_by_group():
    group = np.array([1, 0, 1, 0, 1])
    first = np.array([0, 0, 3, 20, 30])
    f, last, n, i = keys.merge_presses(first, first, np.ones(5, np.int64), 5, group)
    assert sorted(zip(group[i].tolist(), f.tolist(), last.tolist(), n.tolist())) == [(0, 0, 0, 1), (0, 20, 20, 1), (1, 0, 3, 2), (1, 30, 30, 1)]


def test_shots_only_where_actors_look(spark):
    """5,000 projectiles over 5,000 cells and owners, three of them in an actor's cell."""
    actors = spark.createDataFrame([(1, 0.0, 0.0, 10), (2, 9000.0, 0.0, 100)], "id long, x double, y double, hp int")
    far = spark.range(5000).select((F.col("id") + 100).alias("owner"), (F.col("id") + 10.0).alias("x"), F.lit(3.0).alias("y"))
    near = spark.createDataFrame([(2, 0.0, 0.0), (1, 0.0, 0.0), (7, 9000.0, 0.0)], "owner long, x double, y double")
    shots = state.cell_shots(actors, far.unionByName(near), 50)
    got = {(r["_k"], r["_k1"], r["_k2"]): (r["_lo"], r["_hi"], r["_win"]) for r in shots.collect()}
    assert got[0, 0, 0] == (1, 2, True) and got[0, 9000, 0][:2] == (7, 7) and got[1, 2, 0][2] is True and len(got) == 3
    hits = {r.id: (r.hit, r.win) for r in state.cell_hits(actors, far.unionByName(near), 50).collect()}
    assert hits == {1: (True, False), 2: (True, True)}


def test_the_packed_grid_is_never_broadcast(spark):
    w = World(spark, SF_SMALL)
    looked_up = w.packed().lookup(w.targets().withColumns({"cx": F.col("x").cast("long"), "cy": F.col("y").cast("long")}))
    near = sight.neighbourhood(w.actors(), w.packed(), w.vp)
    for df in (looked_up, near):
        joins = [p for p in plan(df).splitlines() if "_gw" in p and "Join" in p or "SortMergeJoin LeftOuter" in p]
        assert joins and not any("Broadcast" in p for p in joins)
    assert "BroadcastHashJoin LeftOuter" not in plan(looked_up)


def test_march_rows_are_not_sorted(spark):
    w = World(spark, SF_SMALL)
    for df in (sight.ray_march(w.actors(), w.packed(), w.vp), sight.visible_entries(w.actors(), w.packed(), w.vp)):
        assert "Window" not in plan(df)


def test_rectangles_are_dealt_over_tasks_before_their_rows(spark):
    """One task reads the table; the rows of its rectangles are added up by several."""
    r = spark.range(0, 100, 1, 1).selectExpr("id AS x1", "id + 3 AS x2", "0L AS y1", "50L AS y2")
    assert "RoundRobinPartitioning(8)" in plan(raster.overlap_counts(r))
    assert raster.overlap_counts(r).agg(F.sum("n")).first()[0] == 100 * 4 * 51


def test_accepted_rows_carry_no_payload(spark, monkeypatch):
    """The joins with the parents and the state read the columns of the rules only."""
    d = tempfile.mkdtemp(prefix="tessera-narrow-")
    rows = [(i // 2, i % 2, at(i), "x" * 50) for i in range(20)] + [(0, 0, at(1), "again"), (99, 0, at(2), "orphan"), (1, None, at(3), "null")]
    pq.write_table(spark.createDataFrame(rows, "k long, n int, ts timestamp_ntz, payload string").toArrow(), os.path.join(d, "t.parquet"), coerce_timestamps="us")
    seen, run = [], keys.run_batches
    monkeypatch.setattr(keys, "run_batches", lambda df, *a: (seen.append(plan(df.filter("_accepted"))), run(df, *a))[1])
    parent = spark.range(10).withColumnRenamed("id", "p")
    good, bad = keys.enforce_keys(keys.row_stream(spark, d, "t"), "t-narrow", ["k", "n"], "ts", "1 hour", parents=[("fk", ["k"], parent, ["p"])])
    assert {r.payload for r in good.collect()} <= {"x" * 50, "again"}
    assert good.count() == 20 and good.filter("payload IS NULL").count() == 0
    assert sorted((r.payload, r.rule) for r in bad.collect() if r.rule != "pk") == [("null", "not_null"), ("orphan", "fk")]
    assert bad.filter("rule = 'pk'").count() == 1
    lines = seen[0].splitlines()
    read = [lines[i + 1] for i, p in enumerate(lines) if p.endswith(") StreamingDeduplicateWithinWatermark")]
    assert read and "Input" in read[0] and "payload" not in read[0]


def test_words_of_the_grid_are_made_by_several_tasks(spark):
    """One file of 5,000 parts in 25 bands: no task has the words of all bands."""
    d = tempfile.mkdtemp(prefix="tessera-bands-")
    parts = spark.range(0, 5000, 1, 1).selectExpr("id AS p_partkey", "CAST(id % 40 AS INT) AS p_size")
    pq.write_table(parts.toArrow(), os.path.join(d, "part.parquet"))
    w = World(spark, d)
    for df in (w.grid_rows(), *(layer for layer, _ in w.layers())):
        tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(F.floor(F.col("y") / w.wp.tile_h)).alias("n")).collect()
        assert len(tasks) > 4 and max(t.n for t in tasks) < 13 and sum(t.n for t in tasks) == 25
    assert w.grid().exceptAll(w.grid_by_overlay()).count() == 0 and w.grid().count() == 25 * w.wp.tile_h * w.wp.tile_w


def test_parts_are_not_broadcast_for_actors(spark):
    assert "Broadcast" not in plan(World(spark, SF_SMALL).actors())


def test_targets_are_dealt_before_they_become_pixels(spark):
    w = World(spark, SF_SMALL)
    lod = spark.range(0, 64, 1, 1).selectExpr("7L AS obs_id", "id AS target_id", "64 AS screen_x", "32 AS screen_y", "2.0D AS depth",
                                              "1.0D AS world_w", "1.0D AS world_h", "2 AS eff_stamp")
    pixels = camera.span_pixels(camera.stamp_spans(camera.stamp_expand(lod, w.stamps(), w.stamp_pixels(), w.vp, catalogue_rows=1000), w.vp))
    tasks = pixels.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("target_id").alias("n")).collect()
    assert len(tasks) > 4 and max(t.n for t in tasks) < 32 and sum(t.n for t in tasks) == 64


def test_replay_sends_no_walked_steps_to_the_driver(spark, monkeypatch):
    """The cells around a key, and the steps folded over them, are merged with."""
    plans, staged = [], replay.staged
    monkeypatch.setattr(replay, "staged", lambda df, name: (plans.append((name, plan(df))), staged(df, name))[1])
    acts = [(k, T0 + dt.timedelta(seconds=i), i, "w") for k in (1, 2) for i in range(40)]
    acts = spark.createDataFrame(acts, "key long, ts timestamp_ntz, seq long, action string")
    starts = spark.createDataFrame([(1, 2.0, 2.0, 0.0), (2, 2.0, 3.0, 0.0)], "id long, x double, y double, dir double")
    cells = spark.range(0, 64).selectExpr("id % 8 AS x", "id div 8 AS y")
    grid = raster.PackedGrid.from_layers([(cells.limit(0), "R"), (cells, ".")], 64, spark.range(8).selectExpr("id AS y"))
    out, _ = replay.replay(starts, acts, grid)
    assert out.filter("moved").count() == 2 * 18 and out.count() == 80
    folded = [p for name, p in plans if name.endswith("-folded")]
    assert folded and not any("Broadcast" in p.split("MapInArrow")[-1] for p in folded)
    walked = [p for p in plan(out).split("\n\n") if "w_i" in p and "Join" in p.splitlines()[0]]
    assert walked and not any("Broadcast" in p for p in walked)


def test_projectiles_are_not_sorted_for_walls_or_cells(spark):
    """The words and the actors' cells are hashed; the projectiles, which outnumber them, pass by."""
    w = World(spark, SF_SMALL)
    p = w.projectiles()
    for df, joins in ((spatial.unblocked(p, w.packed()), 1), (spatial.blocked(p, w.packed()), 1),
                      (state.expire_hits(p, w.actors()), 1), (state.cell_shots(w.actors(), spatial.unblocked(p, w.packed()), 50), 2)):
        steps = [re.sub(r"^[\s:+|-]*(\* )?", "", line) for line in plan(df).split("\n\n")[0].splitlines()]
        assert sum(s.startswith("ShuffledHashJoin") and "BuildRight" in s for s in steps) == joins
        # the streamed side is the first below a join: from the last join down to the table, nothing sorts
        last = max(i for i, s in enumerate(steps) if s.startswith("ShuffledHashJoin"))
        down = steps[last:next(i for i, s in enumerate(steps) if i > last and s.startswith("Scan"))]
        assert not any(s.startswith(("Sort", "Broadcast")) for s in down)


def test_hits_over_hashed_sides_are_those_of_the_definition(spark):
    """Repeated and NULL owners, places on, between and off the cells."""
    cells = spark.range(0, 64).selectExpr("id % 8 AS x", "id div 8 AS y")
    rows = spark.range(8).selectExpr("id AS y")
    floor = cells.filter("(x + y) % 3 <> 0")
    packed = raster.PackedGrid.from_layers([(cells.limit(0), "R"), (floor, ".")], 8, rows)
    shots = spark.range(400).selectExpr("IF(id % 13 = 0, NULL, id % 5) AS owner", "IF(id % 29 = 0, NULL, (id * 7 % 100) / 10.0D - 1) AS x",
                                        "(id * 11 % 90) / 10.0D AS y")
    shots = shots.unionByName(shots.filter("owner = 3"))
    walls = {(r.x, r.y) for r in packed.cells().filter("tile = '#'").collect()}
    want = sum(None in (r.x, r.y) or (round(r.x), round(r.y)) not in walls for r in shots.collect())
    live = spatial.unblocked(shots, packed)
    assert live.count() == want and live.count() + spatial.blocked(shots, packed).count() == shots.count()
    actors = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.2, 0.9), (3, 4.0, 4.0), (3, 4.0, 4.0), (4, None, 2.0)], "id long, x double, y double")
    at_cell = {}
    for a in actors.collect():
        if a.x is not None:
            at_cell.setdefault((round(a.x), round(a.y)), set()).add(a.id)
    stay = sum(r.owner is None or r.x is None or not at_cell.get((round(r.x), round(r.y)), set()) - {r.owner} for r in live.collect())
    assert state.expire_hits(live, actors).count() == stay < live.count()
