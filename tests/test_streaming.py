"""Streaming jobs: several micro-batches must give the batch answer."""

import os
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.operators import state
from tessera.sources.world import World
from tessera.streaming import jobs

from conftest import SF_SMALL


def _split_events(n_files: int = 4) -> str:
    """Events of sf0.001 split by time into several files (one micro-batch each)."""
    d = tempfile.mkdtemp(prefix="tessera-events-")
    t = pq.read_table(f"{SF_SMALL}/events.parquet").sort_by("ts")
    step = (t.num_rows + n_files - 1) // n_files
    base = 1_700_000_000
    for i in range(n_files):
        f = os.path.join(d, f"events-{i}.parquet")
        pq.write_table(t.slice(i * step, step), f)
        # the file source takes files oldest first by modification time (ms); files
        # written within one millisecond would tie, so give the log its time order
        os.utime(f, (base + i, base + i))
    return d


def test_stream_token_bucket_equals_batch(spark):
    d = _split_events()
    w = World(spark, SF_SMALL)
    acts = jobs.action_stream(spark, d, table="events-*", max_files_per_trigger=1)
    streamed = jobs.run_to_parquet(jobs.token_bucket_stream(acts, 3, 3600), "test-bucket")
    batch = state.token_bucket(w.actions(), 3, 3600).select("key", "seq", "allowed", "tokens")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_stream_latest_action_emits_only_closed_windows(spark):
    out = jobs.run_to_parquet(jobs.latest_action_windows(jobs.action_stream(spark, SF_SMALL)), "test-latest")
    mx = spark.read.parquet(f"{SF_SMALL}/events.parquet").agg(F.max("ts")).first()[0]
    import datetime as dt
    cut = mx - dt.timedelta(hours=1)
    assert out.filter(F.col("window_end") > F.lit(cut)).count() == 0
    assert out.count() > 0


def test_late_and_unordered_files(spark):
    """Rows of a file in any order are folded in time order; a late file is folded when it
    arrives.  Late rows of a closed window are dropped."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    def rows(*secs):
        return [(1, t0 + dt.timedelta(seconds=s), 1000 + s, "purchase") for s in secs]
    d = tempfile.mkdtemp(prefix="tessera-late-")
    for i, part in enumerate([rows(3, 0, 2, 1), rows(180_000), rows(180_060), rows(5, 4)]):
        f = os.path.join(d, f"events-{i}.parquet")
        spark.createDataFrame(part, "user_id long, ts timestamp_ntz, event_id long, event_type string").toPandas().to_parquet(f, coerce_timestamps="us")
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    acts = jobs.action_stream(spark, d, table="events-*", max_files_per_trigger=1)
    got = {r.seq: (r.allowed, r.tokens) for r in jobs.run_to_parquet(jobs.token_bucket_stream(acts, 3, 3600), "test-late").collect()}
    assert got == {1000: (1, 2), 1001: (1, 1), 1002: (1, 0), 1003: (0, 0), 181000: (0, 3), 181060: (1, 2), 1004: (1, 1), 1005: (1, 0)}
    acts = jobs.action_stream(spark, d, table="events-*", max_files_per_trigger=1)
    win = jobs.run_to_parquet(jobs.latest_action_windows(acts), "test-late-windows").collect()
    assert [(r.key, r.seq) for r in win] == [(1, 1003)]
