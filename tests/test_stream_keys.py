"""Held, released and enforced keys: streams of several files against plain loops."""

import datetime as dt
import os
import random
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions.num import epoch_micros
from tessera.streaming import jobs, keys

T0 = dt.datetime(2024, 1, 1)
EVENTS = "user_id long, ts timestamp_ntz, event_id long, event_type string"


def write_files(spark, parts, schema, name="events", d=None, first=0):
    """One file per part, in this order."""
    d = d or tempfile.mkdtemp(prefix="tessera-stream-")
    for i, part in enumerate(parts, first):
        f = os.path.join(d, f"{name}-{i}.parquet")
        pq.write_table(spark.createDataFrame(part, schema).toArrow(), f, coerce_timestamps="us")
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return d


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def stream(spark, d):
    return jobs.action_stream(spark, d, table="events-*", max_files_per_trigger=1)


def test_held_join_equals_the_nearest_press(spark):
    """Exact tolerance, several presses, equal times, other keys, NULL keys and times; a late
    press and a late tick change nothing; the state does not grow."""
    rnd = random.Random(6)
    parts, n = [], 0
    for f in range(8):
        rows = []
        for _ in range(30):
            n += 1
            rows.append((rnd.choice([1, 1, 1, 2, None]), at(f * 1000 + rnd.randrange(8000) / 10), n, rnd.choice(["click", "view", "purchase"])))
        parts.append(rows)
    late = [(1, at(5), 9001, "click"), (1, None, 9002, "click")]
    d = write_files(spark, [*parts, late + [(1, at(9000), 9003, "view")], [(1, at(12_000), 9004, "view")]], EVENTS)
    spark_ticks = keys.row_stream(spark, d, "events-*", 1).select(
        F.col("event_id").alias("tick_id"), F.col("user_id").alias("key"), (epoch_micros("ts") + F.col("event_id") % 4 * 50_000).alias("tick_us"))
    progress = []
    pairs = jobs.run_to_parquet(keys.held_pairs(spark_ticks, stream(spark, d), 100_000, "600 seconds"), "t-held", progress=progress)
    got = {r.tick_id: r.action for r in keys.held_of_pairs(pairs).collect()}

    def us(t):
        return (t - T0) // dt.timedelta(microseconds=1)
    letter = {"click": "w", "view": "s", "purchase": "x"}
    events = [r for p in parts for r in p] + [(1, at(9000), 9003, "view"), (1, at(12_000), 9004, "view")]
    want = {}
    for k, t, i, _ in events:
        tick = us(t) + i % 4 * 50_000
        near = [(us(t2), j, letter[e]) for k2, t2, j, e in events if k is not None and k2 == k and tick - 100_000 <= us(t2) <= tick]
        want[i] = max(near)[2] if near else None
    closed = {i for k, t, i, _ in events if us(t) < us(at(12_000 - 600 - 2))}
    assert closed <= set(got) and 9002 not in got
    assert {i: got[i] for i in closed} == {i: want[i] for i in closed}
    assert {i: a for i, a in got.items() if i in want and want[i] is not None} == {i: a for i, a in want.items() if a is not None}
    rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert max(rows) <= 4 * 30 * 2 and rows[-1] <= 4         # a file or two of each side, then what is not closed


def naive_release(rows, hold, mark):
    by_key = defaultdict(list)
    for k, a, s in rows:
        by_key[k, a].append(s)
    out = Counter()
    for (k, a), times in by_key.items():
        run = []
        for s in sorted(times) + [None]:
            if run and (s is None or s - run[-1] > hold):
                if run[-1] + hold < mark:
                    out[k, a, run[0], run[-1] + hold, len(run)] += 1
                run = []
            run.append(s)
    return out


def test_release_equals_gaps_and_islands(spark):
    """Rows within a file and neighbouring files out of order (within the delay), a run over all
    files, a gap of exactly the hold, NULL keys; state stays small."""
    rnd = random.Random(7)
    hold, delay = 50, 300
    rows = [(rnd.choice([1, 2, None]), rnd.choice(["click", "view"]), rnd.randrange(3000)) for _ in range(160)]
    rows += [(3, "click", s) for s in range(0, 3000, hold)] + [(4, "view", s) for s in range(0, 3000, hold + 1)]
    parts = [[(k, at(s), i, e) for i, (k, e, s) in enumerate(rows) if f * 300 <= s + (i * 37 % 120) < f * 300 + 300] for f in range(11)]
    for p in parts:
        rnd.shuffle(p)
    parts = [p for p in parts if p]
    d = write_files(spark, parts, EVENTS)
    progress = []
    out = jobs.run_to_parquet(keys.release_intervals(stream(spark, d), hold * 1_000_000, f"{delay} seconds"), "t-release", progress=progress)
    e0 = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    got = Counter((r.key, r.action, r.pressed / 1e6 - e0, r.released / 1e6 - e0, r.presses) for r in out.collect())
    letter = {"click": "w", "view": "s"}
    mark = max(s for _, _, s in rows) - delay
    assert got == naive_release([(k, letter[e], s) for k, e, s in rows], hold, mark)
    assert any(n == 1 for *_, n in got) and any(n > 3 for *_, n in got)
    assert max(o["numRowsTotal"] for p in progress for o in p["stateOperators"]) <= 8


def test_a_late_press_is_left_out(spark):
    d = write_files(spark, [[(1, at(0), 1, "click")], [(1, at(1000), 2, "click")], [(1, at(5), 3, "click"), (1, at(2000), 4, "click")],
                            [(1, at(9000), 5, "view")]], EVENTS)
    out = jobs.run_to_parquet(keys.release_intervals(stream(spark, d), 10_000_000, "60 seconds"), "t-release-late").collect()
    assert sorted((r.action, r.presses) for r in out) == [("w", 1), ("w", 1), ("w", 1)]


@pytest.mark.parametrize("seed", range(20))
def test_merged_presses(seed):
    rnd = random.Random(seed)
    spans = [(s, s + rnd.randrange(20), rnd.randrange(1, 4)) for s in (rnd.randrange(300) for _ in range(25))]
    f, last, n = keys.merge_presses(*(np.array(c) for c in zip(*spans)), 7)
    want = []
    for a, b, k in sorted(spans, key=lambda s: s[0]):
        if want and a - want[-1][1] <= 7:
            want[-1] = [want[-1][0], max(want[-1][1], b), want[-1][2] + k]
        else:
            want.append([a, b, k])
    assert [list(x) for x in zip(f.tolist(), last.tolist(), n.tolist())] == want


ROWS = "k long, p long, v string, t timestamp_ntz"


def enforce(spark, d, **kw):
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    return keys.enforce_keys(keys.row_stream(spark, d, "rows-*", 1), "t-enforce", ["k"], "t", "1000 seconds", required=["v"],
                             parents=[("fk", ["p"], parents, ["id"])], **kw)


def test_enforced_keys_split_the_input(spark):
    """Repeats within a file, across files and across a restart, NULLs, missing parents, equal
    rows; every row lands in one sink, once."""
    rnd = random.Random(9)
    parts = [[(rnd.choice([None, *range(25)]), rnd.choice([1, 2, 3, None]), rnd.choice(["a", "b", None]), at(f * 10 + rnd.randrange(10))) for _ in range(40)]
             for f in range(4)]
    d = write_files(spark, parts[:3], ROWS, "rows")
    base = tempfile.mkdtemp(prefix="tessera-sinks-")
    where = dict(sinks=(f"{base}/good", f"{base}/bad"), ckpt=f"{base}/ckpt")
    enforce(spark, d, **where)
    write_files(spark, parts[3:], ROWS, "rows", d, first=3)
    good, bad = (x.collect() for x in enforce(spark, d, **where))
    rows = [r for p in parts for r in p]
    assert Counter(tuple(r) for r in good) + Counter(tuple(r)[:4] for r in bad) == Counter(rows)

    def rule(r):
        return "not_null" if r[0] is None or r[2] is None else "fk" if r[1] == 3 else None
    fine = [r for r in rows if rule(r) is None]
    assert sorted(r.k for r in good) == sorted({r[0] for r in fine})
    assert Counter(r.rule for r in bad) == Counter(filter(None, map(rule, rows))) + Counter({"pk": len(fine) - len(good)})
    assert all(rule(tuple(r)[:4]) in (None, r.rule) and (r.rule == "pk") == (rule(tuple(r)[:4]) is None) for r in bad)


def test_a_key_is_free_again_behind_the_watermark(spark):
    # Spark forgets a key, and tells a late row, in the micro-batch after the watermark has passed
    parts = [[(1, 1, "a", at(0))], [(1, 1, "b", at(500))], [(2, 1, "c", at(5000))], [(2, 1, "e", at(5000))], [(1, 1, "d", at(5001)), (9, 1, "late", at(3))]]
    good, bad = enforce(spark, write_files(spark, parts, ROWS, "rows"))
    assert sorted(r.v for r in good.collect()) == ["a", "c", "d"]
    assert sorted((r.v, r.rule) for r in bad.collect()) == [("b", "pk"), ("e", "pk"), ("late", "pk")]
