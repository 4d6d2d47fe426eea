"""The state table: upserts, deletions and replayed batches against a dictionary."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import state
from tessera.session import scratch_path
from tessera.sources.state_table import StateTable
from tessera.sources.world import World
from tessera.streaming import jobs

from conftest import SF_SMALL
from test_streaming import _split_events

COLS = "name string, id long, v long, at long"


def table(spark, buckets=8, key=("name", "id")):
    return StateTable(spark, scratch_path(spark, "t"), list(key), COLS, buckets)


def content(t):
    return {(r.name, r.id): (r.v, r["at"]) for r in t.read().collect()}


def files(t):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, fs in os.walk(t.path.removeprefix("file:")) for f in fs if f.endswith(".parquet")}


def test_merges_equal_a_dictionary(spark):
    """Several batches with repeated keys, stale rows, deletions, NULL keys and orders."""
    rnd = random.Random(4)
    t, want = table(spark), {}
    t.create(spark.createDataFrame([], COLS))
    assert content(t) == {}

    def beats(a, b):            # a null order value is the oldest
        return (a is not None, a or 0) >= (b is not None, b or 0)
    for batch in range(4):
        rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1, 2, 3, 4, 5]), batch * 1000 + i, rnd.choice([None, *range(batch * 3, batch * 3 + 9)]),
                 rnd.random() < 0.2) for i in range(25)]
        last = {}
        for n, i, v, at, gone in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[0] is not None, r[0] or "", r[1] or 0, r[2])):
            last[n, i] = (v, at, gone)
        for k, (v, at, gone) in last.items():
            if k not in want or beats(at, want[k][1]):
                want.pop(k, None)
                if not gone:
                    want[k] = (v, at)
        t.merge(spark.createDataFrame(rows, f"{COLS}, gone boolean").repartition(3), batch, order=["at"], delete="gone")
        assert content(t) == want
    assert None in {n for n, _ in want} or want
    assert t.merge(spark.createDataFrame([], COLS), 9, order=["at"]) == []


def test_only_touched_buckets_are_rewritten(spark):
    t = table(spark, buckets=32, key=("id",))
    t.create(spark.range(500).selectExpr("'x' AS name", "id", "0L AS v", "0L AS at"))
    before = files(t)
    touched = t.merge(spark.createDataFrame([("y", 7, 1, 1), ("y", 7, 2, 2), ("y", 100_000, 3, 3)], COLS), 0, order=["at"])
    after = files(t)
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if not any(f"_bucket={b}/" in f for b in touched)}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not any(f in after for f in before.keys() - kept)
    assert t.read().count() == 501 and content(t)["y", 7] == (2, 2)


def test_a_replayed_batch_changes_nothing(spark):
    """Sums, where a second application would show; also after a batch that reached one bucket only."""
    t = table(spark, buckets=16, key=("id",))
    t.create(spark.createDataFrame([], COLS))
    rows = spark.createDataFrame([("x", i, 10, 0) for i in range(40)], COLS)

    def add(old, new):
        return {"v": old["v"] + new["v"]}
    t.merge(rows, 0, combine=add)
    t.merge(rows, 1, combine=add)
    before = files(t)
    assert t.merge(rows, 1, combine=add) == [] and files(t) == before
    assert {v for v, _ in content(t).values()} == {20}
    part = rows.filter("id < 3")            # as if batch 2 had been cut off after these buckets
    reached = t.merge(part, 2, combine=add)
    rest = t.merge(rows, 2, combine=add)
    assert not set(reached) & set(rest)
    b = {r.id: r.b for r in rows.withColumn("b", t.bucket()).collect()}
    got = content(t)
    for i in range(40):
        assert got["x", i][0] == (30 if i < 3 or b[i] not in reached else 20)


def test_deleting_the_last_row_empties_a_bucket(spark):
    t = table(spark, buckets=1, key=("id",))
    t.create(spark.createDataFrame([("x", 1, 1, 1)], COLS))
    gone = spark.createDataFrame([("x", 1, 1, 2, True), ("x", 2, 1, 2, True)], f"{COLS}, gone boolean")
    assert t.merge(gone, 0, delete="gone") == [0] and content(t) == {}
    t.merge(spark.createDataFrame([("z", 1, 5, 5)], COLS), 1)
    assert content(t) == {("z", 1): (5, 5)}
    t.create(spark.createDataFrame([("n", 3, 0, 0)], COLS))         # truncate and load
    assert content(t) == {("n", 3): (0, 0)}


def test_stream_equals_latest_action_and_survives_a_replay(spark):
    """One micro-batch per file; then every micro-batch is delivered again from the start."""
    d = _split_events()
    acts = jobs.action_stream(spark, d, table="events-*", max_files_per_trigger=1)
    t = StateTable(spark, scratch_path(spark, "stream-table"), ["key"], jobs.LATEST, 8)
    t.create(spark.createDataFrame([], jobs.LATEST))
    jobs.latest_action_table(acts, t)
    want = state.latest_action(World(spark, SF_SMALL).actions())
    cols = ["key", "action", "ts", "seq"]

    def same():
        got = t.read().select(*cols)
        return got.count() == want.count() and got.exceptAll(want.select(*cols)).count() == 0
    assert same()
    before = files(t)
    jobs.latest_action_table(acts, t)        # a new checkpoint: batch ids start at 0 again
    assert same()
    # the last batch touched every key's bucket at most; buckets it did not touch were not rewritten by older ones
    assert {f for f in before if f in files(t)} == set(before)
