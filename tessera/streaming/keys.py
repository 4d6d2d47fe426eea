"""S - keys held, released and enforced on streams with an event time.

``held_pairs``: two watermarked streams joined within a time interval (which bounds the
state), outer rows given once the watermark has passed.  ``release_intervals``: a key counts
as held until ``hold`` after its last press; intervals leave by an event-time timer.
``enforce_keys``: rows that keep the rules of a table and rows that break one, in two sinks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.functions.num import epoch_micros
from tessera.session import scratch_path, staged
from tessera.streaming.jobs import run_batches


# ---- held action: stream-stream join -------------------------------------------------

def held_pairs(ticks: DataFrame, actions: DataFrame, tolerance_us: int = 100_000, delay: str = "1 hour") -> DataFrame:
    """Every tick (tick_id, key, tick_us) with the actions of its key that are at most
    ``tolerance_us`` older (exactly that still counts), or with NULLs once no such action can
    arrive any more.  Both inputs are streams; a row behind the watermark is dropped.  The
    time condition lets Spark forget actions older than the watermark less the tolerance, and
    ticks older than the watermark.  Ticks without a time are left out."""
    t = (ticks.filter("tick_us is not null").select("tick_id", "key", "tick_us", F.timestamp_micros("tick_us").alias("tts"))
         .withWatermark("tts", delay))
    a = actions.select(F.col("key").alias("a_key"), F.col("ets"), F.col("seq").alias("a_seq"), F.col("action").alias("a_action"))
    a = a.withWatermark("ets", delay)
    near = F.expr(f"key = a_key AND ets <= tts AND ets >= tts - make_dt_interval(0, 0, 0, {tolerance_us} / 1000000.0)")
    return t.join(a, near, "left_outer").select("tick_id", "key", "tick_us", F.unix_micros("ets").alias("a_us"), "a_seq", "a_action")


def held_of_pairs(pairs: DataFrame) -> DataFrame:
    """(tick_id, key, tick_us, action): the latest of a tick's actions (by time, then seq)."""
    best = F.max_by("a_action", F.when(F.col("a_us").isNotNull(), F.struct("a_us", "a_seq")))
    return pairs.groupBy("tick_id", "key", "tick_us").agg(best.alias("action"))


# ---- release: event-time timer ---------------------------------------------------------

RELEASE_OUT = "key long, action string, pressed long, released long, presses long"
RELEASE_STATE = "key array<long>, no_key array<boolean>, action array<string>, pressed array<long>, last array<long>, presses array<long>"
RELEASE_BUCKETS = 2048


def merge_presses(first: np.ndarray, last: np.ndarray, n: np.ndarray, hold_us: int, group: np.ndarray | None = None):
    """Intervals (first, last, number of presses) joined where the next one begins at most
    ``hold_us`` after all before have ended.  With ``group`` (numbers) only those of one group
    are joined, and the place of an interval of the group is given, too."""
    of = np.zeros(len(first), np.int64) if group is None else group
    order = np.lexsort((first, of))
    first, last, n, of = first[order], last[order], n[order], of[order]
    reach = pd.Series(last).groupby(of, sort=False).cummax().to_numpy()
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (first[1:] - reach[:-1] > hold_us)]))
    merged = first[new], np.maximum.reduceat(last, new), np.add.reduceat(n, new)
    return merged if group is None else (*merged, order[new])


def _release_fn(hold_us: int):
    names = ["key", "no_key", "action", "first", "last", "n"]

    def fn(_, pdfs, state):
        mark = state.getCurrentWatermarkMs() * 1000
        parts = [pd.DataFrame(dict(zip(names, map(list, state.get))))] if state.exists else []
        if not state.hasTimedOut:
            for p in pdfs:
                p = p[p["us"] >= mark]              # late: its interval may have been given already
                parts.append(p[["key", "no_key", "action"]].assign(first=p["us"], last=p["us"], n=1))
        rows = pd.concat([p for p in parts if len(p)], ignore_index=True) if any(map(len, parts)) else None
        if rows is None:
            return
        group = rows.groupby(names[:3], sort=False, dropna=False).ngroup().to_numpy()
        first, last, n, at = merge_presses(*(rows[c].to_numpy(np.int64) for c in names[3:]), hold_us, group)
        rows = rows[names[:3]].iloc[at].assign(first=first, last=last, n=n)
        closed = last + hold_us < mark              # nothing that is not late can reach it
        if closed.all():
            state.remove()
        else:
            state.update(tuple(rows[c][~closed].tolist() for c in names))
            state.setTimeoutTimestamp(int((last[~closed].min() + hold_us) // 1000))
        if closed.any():
            out = rows[closed]
            key = pd.arrays.IntegerArray(out["key"].to_numpy(np.int64), out["no_key"].to_numpy(bool))
            yield pd.DataFrame({"key": key, "action": out["action"].to_numpy(), "pressed": out["first"].to_numpy(),
                                "released": out["last"].to_numpy() + hold_us, "presses": out["n"].to_numpy()})
    return fn


def release_intervals(actions: DataFrame, hold_us: int = 100_000, delay: str = "1 hour", buckets: int = RELEASE_BUCKETS) -> DataFrame:
    """(key, action, pressed, released, presses): from the first press to ``hold_us`` after the
    last one of a run of presses, each at most ``hold_us`` after the one before; given when the
    watermark has passed ``released``.  Rows of a micro-batch may come in any order.  Rows
    behind the watermark, and rows without a time, are left out.

    Keys are dealt over ``buckets`` by a hash, and a bucket is folded at once, so Python is
    called for buckets and not for keys, however many there are.  The state of a bucket are
    the open intervals of its keys, which lie within the delay.  A stream that goes on from
    a checkpoint keeps its number of buckets."""
    # a NULL key travels as a flag: pandas would make the column one of doubles
    src = (actions.filter("ets is not null").withWatermark("ets", delay)
           .select(F.coalesce(F.col("key").cast("long"), F.lit(0).cast("long")).alias("key"), F.col("key").isNull().alias("no_key"),
                   "action", "ets", F.unix_micros("ets").alias("us"),
                   F.pmod(F.xxhash64("key", "action"), F.lit(buckets)).alias("bucket")))
    return src.groupBy("bucket").applyInPandasWithState(
        _release_fn(int(hold_us)), RELEASE_OUT, RELEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- keys enforced on arriving rows --------------------------------------------------------

def row_stream(spark: SparkSession, sf_dir: str, table: str, max_files_per_trigger: int = 8) -> DataFrame:
    """A table as a stream of its rows with ``_row``, which tells every row apart (its file and
    its number there)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(sf_dir)
            .select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("n")).alias("_row")))


def enforce_keys(rows: DataFrame, name: str, key: list[str], time: str, delay: str, required: list[str] = (),
                 parents: list[tuple[str, list[str], DataFrame, list[str]]] = (), sinks: tuple[str, str] | None = None,
                 ckpt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a stream of rows (see ``row_stream``) against the rules of a table; gives the accepted
    rows and the rejected ones with the ``rule`` they break:

    * ``not_null`` - a column of ``key``, ``required`` or the time is NULL;
    * a name of ``parents`` (name, columns, parent table, parent columns) - no such parent
      row (a NULL column refers to nothing and is allowed);
    * ``pk`` - a row with this key was accepted before, within ``delay`` of event time at
      least (Spark forgets a key with the micro-batch after the watermark has passed it),
      or the row is behind the watermark, where that is no longer known.

    The first rule that is broken counts.  Spark keeps the accepted keys
    (``dropDuplicatesWithinWatermark``) until the watermark has passed them, which bounds
    the state.  Both sinks are written per micro-batch, into a folder of its number, so a
    micro-batch that is delivered again replaces its own rows: every input row is in one
    sink, once."""
    spark = rows.sparkSession
    good, bad = sinks or (scratch_path(spark, f"{name}-accepted"), scratch_path(spark, f"{name}-rejected"))
    cols = [c for c in rows.columns if c != "_row"]
    schema = rows.select(*cols).schema

    def with_rule(df: DataFrame) -> DataFrame:
        """Adds the first rule but ``pk`` that a row breaks."""
        null = F.lit(False)
        for c in (*key, *required, time):
            null = null | F.col(c).isNull()
        checked, rule = df.withColumn("_null", null), F.when(F.col("_null"), F.lit("not_null"))
        for i, (parent, child_cols, table, parent_cols) in enumerate(parents):
            known = table.select(*[F.col(p).alias(f"_p{i}_{j}") for j, p in enumerate(parent_cols)]).distinct().withColumn(f"_ok{i}", F.lit(True))
            on = [F.col(c) == F.col(f"_p{i}_{j}") for j, c in enumerate(child_cols)]
            checked = checked.join(known, on, "left")
            refers = F.lit(True)
            for c in child_cols:
                refers = refers & F.col(c).isNotNull()
            rule = rule.when(refers & F.col(f"_ok{i}").isNull(), F.lit(parent))
        return checked.select(*df.columns, rule.alias("rule"))
    stamp = F.timestamp_micros(epoch_micros(time)) if schema[time].dataType.typeName() == "timestamp_ntz" else F.col(time).cast("timestamp")
    # of the accepted rows only ``_row`` is taken, so the joins and the state move what the
    # rules read; the whole rows come straight from the source
    accepted = (with_rule(rows).filter("rule IS NULL").withColumn("_ets", stamp).withWatermark("_ets", delay)
                .dropDuplicatesWithinWatermark(key).select("_row", F.lit(True).alias("_accepted")))
    both = rows.select(*cols, "_row", F.lit(False).alias("_accepted")).unionByName(accepted, allowMissingColumns=True)

    def apply(batch: DataFrame, number: int) -> None:
        # one evaluation: the state moves on once per micro-batch
        got = staged(batch, f"{name}-batch")
        ok = got.filter("_accepted").select(F.col("_row").alias("_ok_row"))
        whole = got.filter("NOT _accepted").join(ok, F.col("_row") == F.col("_ok_row"), "left")
        # whole rows move once, to both sinks
        whole = staged(whole.select(*cols, F.col("_ok_row").isNotNull().alias("_accepted")), f"{name}-judged")
        whole.filter("_accepted").select(*cols).write.mode("overwrite").parquet(f"{good}/batch={number}")
        refused = with_rule(whole.filter("NOT _accepted").select(*cols))
        refused.select(*cols, F.coalesce("rule", F.lit("pk")).alias("rule")).write.mode("overwrite").parquet(f"{bad}/batch={number}")
    run_batches(both, name, apply, ckpt)
    return (spark.read.schema(schema).parquet(good).select(*cols),
            spark.read.schema(schema.add("rule", "string")).parquet(bad).select(*cols, "rule"))
