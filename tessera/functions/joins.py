"""Join-side helpers: ``broadcast`` is only applied behind a bound that follows from
parameters (a catalogue of stamps).  A side that grows with the tables and packs well is
merged with, or hashed where the other side has many rows to stream past it.  Any other side
is left to Spark, which plans a shuffle join and lets AQE convert it from the sizes it measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


MIN_DEALT = 16


def dealt(df: DataFrame, *cols, share: int = 1) -> DataFrame:
    """``df`` over the shuffle partitions, by ``cols``: for small rows that are about to become
    many.  An exchange of a given number of partitions is not merged into fewer by AQE,
    which sees the bytes before the rows grow, nor bound to the splits of a small file.
    ``share``: over that part of them only (``MIN_DEALT`` at least), where the fixed cost of a
    task (a third of a second for an aggregate) is more than what most tasks have to do."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(n, max(MIN_DEALT, n // share)), *cols)


def bounded_broadcast(df: DataFrame, known_rows: int | None = None) -> DataFrame:
    return F.broadcast(df) if known_rows is not None and known_rows <= MAX_BROADCAST_ROWS else df


def by_merge(df: DataFrame) -> DataFrame:
    """A side that is never broadcast.  Spark compares the compressed bytes of a shuffle with
    its threshold; rows that follow a pattern, like the words of a packed grid, pack to a
    few bytes each, so a table of hundreds of megabytes would be sent through the driver
    and held by every task."""
    return df.hint("merge")


def by_hash(df: DataFrame) -> DataFrame:
    """A side with one row per key that is hashed within its shuffle partition, neither
    broadcast nor sorted: the many rows of the other side stream past it, and a task holds its
    share of ``df`` only.  A merge would sort the streamed rows, and a task hold its share of
    those, too, which grows with them where the number of shuffle partitions is fixed."""
    return df.hint("shuffle_hash")
