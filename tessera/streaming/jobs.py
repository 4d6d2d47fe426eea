"""S - Structured Streaming jobs over the action log.

Sources are file streams over the driver's parquet directory (``pathGlobFilter``
selects the table: a file stream cannot be pointed at a single file).  Sinks and
checkpoints live below the shared ``spark.checkpoint.dir`` so a restarted job (or a
lost executor) resumes from the committed offsets and state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.functions.asof import asof_backward
from tessera.functions.num import epoch_micros
from tessera.operators.state import round_second
from tessera.session import scratch_path
from tessera.sources.state_table import StateTable
from tessera.sources.world import ACTION_OF_EVENT

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_from_micros(c) -> F.Column:
    return F.timestamp_add("MICROSECOND", c, F.expr(EPOCH_NTZ))


def action_stream(spark: SparkSession, sf_dir: str, table: str = "events",
                  max_files_per_trigger: int = 8) -> DataFrame:
    """(key, ts NTZ, ets TIMESTAMP, seq, action) as a stream.  ``ets`` is the event
    time as an instant (UTC wall clock), independent of the session zone - the
    watermark needs a zoned timestamp.  A micro-batch reads a bounded number of files."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").schema
    ev = (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
          .option("maxFilesPerTrigger", max_files_per_trigger).parquet(sf_dir))
    m = F.create_map(*[F.lit(x) for kv in ACTION_OF_EVENT.items() for x in kv])
    return (ev.select(F.col("user_id").alias("key"), F.col("ts"),
                      F.timestamp_micros(epoch_micros("ts")).alias("ets"),
                      F.col("event_id").alias("seq"), m[F.col("event_type")].alias("action"))
            .filter(F.col("action").isNotNull()))


def run_to_parquet(df: DataFrame, name: str, output_mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run a streaming DataFrame over everything available, write it to a parquet
    table below the checkpoint folder, and read that table back.  ``progress`` receives
    Spark's reports of the micro-batches."""
    spark = df.sparkSession
    sink, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    q = (df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(sink))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if progress is not None:
        progress.extend(q.recentProgress)
    return spark.read.schema(df.schema).parquet(sink)


def latest_action_windows(actions: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Per key and tumbling event-time window, the last action (by ts, seq).
    Append mode emits a window once the watermark (max event time - delay) passes
    its end; rows behind the watermark are dropped as late."""
    best = F.max_by(F.struct("action", "ts", "seq"), F.struct("ets", "seq"))
    agg = (actions.withWatermark("ets", delay)
           .groupBy(F.window("ets", window).alias("w"), "key").agg(best.alias("b")))
    return agg.select("key",
                      ntz_from_micros(F.unix_micros(F.col("w.start"))).alias("window_start"),
                      ntz_from_micros(F.unix_micros(F.col("w.end"))).alias("window_end"),
                      "b.action", "b.ts", "b.seq")


TOKEN_OUT = "key long, seq long, allowed int, tokens int"
TOKEN_STATE = "tokens int, last long"


def fold_shots(us: np.ndarray, x: np.ndarray, tokens: int, last: int, capacity: int, interval_us: int):
    """(allowed, tokens left) per event in order, and the state after the last one.  The loop
    goes from refill to refill: between two, the first ``tokens`` shots are allowed."""
    allowed, left = np.zeros(len(us), np.int32), np.zeros(len(us), np.int32)
    shots = np.concatenate([[0], np.cumsum(x)])
    i, m = 0, len(us)
    while i < m:
        late = max(i, int(np.searchsorted(us, last + interval_us)))
        if late > i:
            spent = shots[i + 1:late + 1] - shots[i]
            allowed[i:late] = x[i:late] & (spent <= tokens)
            left[i:late] = tokens - np.minimum(spent, tokens)
            tokens, i = int(left[late - 1]), late
            continue
        if tokens == capacity and not x[i]:          # full: the clock stands up to the next shot
            shot = int(np.searchsorted(shots, shots[i] + 1)) - 1
            left[i:shot] = capacity
            i = shot
            continue
        t, ok = int(us[i]), bool(x[i]) and tokens > 0
        tokens = min(capacity, tokens - ok + (t - last) // interval_us)
        allowed[i], left[i], last = ok, tokens, round_second(t)
        i += 1
    return allowed, left, tokens, last


def _token_state_fn(capacity: int, interval_us: int):
    def fn(key, pdfs, state):
        # of a key's rows in one micro-batch only three numbers each are held, to put them
        # in order; the micro-batch is bounded by the source's files per trigger
        parts = [(p["us"].to_numpy(), p["seq"].to_numpy(), (p["action"] == "x").to_numpy()) for p in pdfs]
        us, seq, x = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((seq, us))
        us, seq, x = us[order], seq[order], x[order]
        tokens, last = map(int, state.get) if state.exists else (capacity, round_second(int(us[0])))
        allowed, left, tokens, last = fold_shots(us, x, tokens, last, capacity, interval_us)
        state.update((tokens, last))
        yield pd.DataFrame({"key": pd.array([key[0]] * len(us), dtype="Int64"), "seq": seq, "allowed": allowed, "tokens": left})
    return fn


def token_bucket_stream(actions: DataFrame, capacity: int, interval_s: int) -> DataFrame:
    """The batch ``state.token_bucket`` as a stateful stream: state (tokens, last)
    per key across micro-batches, rows of a batch folded in (ts, seq) order.  Equal
    to the batch result when input arrives in order; a late event is folded when it
    arrives, with the state of that moment (it can't refill backwards).  Events without a
    time are left out."""
    src = actions.filter("ts is not null").select("key", "seq", "action", epoch_micros("ts").alias("us"))
    return src.groupBy("key").applyInPandasWithState(
        _token_state_fn(int(capacity), int(interval_s) * 1_000_000),
        TOKEN_OUT, TOKEN_STATE, "append", GroupStateTimeout.NoTimeout)


def held_action(ticks: DataFrame, actions: DataFrame, tolerance_us: int = 100_000) -> DataFrame:
    """As-of with tolerance: the action held at each tick is the latest action of
    the key at or before the tick (by time, then seq) when it is at most
    ``tolerance_us`` older (exactly the tolerance still counts), else NULL.

    A backward as-of lookup (``functions.asof.asof_backward``): actions and ticks
    meet in (key, tolerance bucket) groups and a running max picks the latest
    action - no tick x action pairs, and a hot key is spread over its buckets."""
    a = actions.select("key", epoch_micros("ts").alias("us"), "seq", "action")
    t = ticks.select("tick_id", "key", "tick_us")
    m = asof_backward(t, a, "key", "tick_us", "us", ["seq"], ["action"], tolerance_us, out="_m")
    return m.select("tick_id", "key", "tick_us", F.col("_m.action").alias("action"))


# ---- state kept up to date by a stream ---------------------------------------------

def run_batches(df: DataFrame, name: str, apply, ckpt: str | None = None) -> str:
    """Run a streaming DataFrame over everything available, each micro-batch through
    ``apply(rows, batch_id)``; gives the checkpoint, from which a later call goes on."""
    ckpt = ckpt or scratch_path(df.sparkSession, f"{name}-ckpt")
    q = (df.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return ckpt


LATEST = "key long, action string, ts timestamp_ntz, seq long"


def latest_action_table(actions: DataFrame, table: StateTable, ckpt: str | None = None) -> str:
    """Keeps ``table`` (columns ``LATEST``) at the newest action of every key.  Each micro-batch
    rewrites the buckets of its keys; one that is delivered twice changes nothing."""
    def apply(rows: DataFrame, batch: int) -> None:
        table.merge(rows.select("key", "action", "ts", "seq"), batch, order=["ts", "seq"])
    return run_batches(actions, "latest", apply, ckpt)
