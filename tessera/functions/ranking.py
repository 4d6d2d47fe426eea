"""Row numbering and running sums that never pull a whole key into one task.

``number_rows``: 1-based rank of every row in a total order (optionally within a
group), computed as  offset(bucket) + rank inside the bucket.  Buckets are ranges of
the order between bounds taken from the rows with the smallest hashes, so two
evaluations of the plan cut the same bounds and nothing runs before the result is
asked for.  Their number grows with the session's shuffle partitions; a row finds its
bucket by binary search.  The rows are shuffled and sorted once; the counts per bucket
are a partial aggregate of their own, and only they are summed by a small window.

``number_rows_once``: the same numbers for an input that is dear to compute.  It is
written once, range-partitioned by Spark and written again, each row with its partition
and its place in it.  Runs when it is called.

``sums_before_once``: likewise the sum of a value over all rows before a row.

The order must be unique for the numbering to be repeatable.

``prefix_sums``: running sums per key over an order, split by a time bucket.
Phase 1 sums inside each (key, bucket) - a hot key spreads over its buckets;
phase 2 turns the per-bucket totals (one row per key and bucket) into offsets;
phase 3 adds the offset back.  Exact for integer inputs (use fixed point for
fractional values), so the split never changes the result.

NULL keys, groups and order values are values of their own: keys are compared as
structs, which hold NULL equal to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import by_merge
from tessera.session import staged

MIN_BUCKETS, MAX_BUCKETS = 128, 1 << 15
SAMPLE_PER_BUCKET = 8
_IN_PARTITION = (1 << 33) - 1      # monotonically_increasing_id: partition above bit 33, row below


def bucket_count(df: DataFrame) -> int:
    """Four buckets per shuffle partition, so that they spread evenly."""
    return max(MIN_BUCKETS, min(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS))


def with_smaller(df: DataFrame, bounds: Column, key: str, most: int, out: str) -> DataFrame:
    """Adds how many entries of a sorted array of at most ``most`` entries are smaller than
    ``key``: one projection per halving, each with one comparison."""
    df = df.withColumn(out, F.lit(0))
    for i in range(most.bit_length() - 1, -1, -1):
        here = F.get(bounds, F.col(out) + F.lit((1 << i) - 1)) < F.col(key)
        df = df.withColumn(out, F.col(out) + F.when(here, F.lit(1 << i)).otherwise(F.lit(0)))
    return df


def number_rows(df: DataFrame, order: list[str], group: list[str] | None = None, out: str = "rn",
                buckets: int | None = None) -> DataFrame:
    """``buckets`` ranges, by default ``bucket_count``."""
    group, n = group or [], buckets or bucket_count(df)
    key, g = F.struct(*group, *order), F.struct(F.lit(0).alias("_z"), *group)
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_PER_BUCKET * n)
    # a bounded array as a scalar subquery; every so many of the sampled keys is a bound
    bounds = sample.agg(F.sort_array(F.collect_list("k")).alias("b")).select(
        F.filter("b", lambda _, i: i % F.greatest(F.lit(1), F.ceil(F.size("b") / F.lit(n))).cast("int") == 0)).scalar()
    b = df.withColumns({"_g": g, "_k": key})
    b = with_smaller(b, bounds, "_k", n, "_b")
    local = b.withColumn("_lrn", F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_k")))
    counts = b.groupBy(F.col("_g").alias("_g2"), F.col("_b").alias("_b2")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g2").orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g2", "_b2", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (local.join(offsets, (F.col("_g") == F.col("_g2")) & (F.col("_b") == F.col("_b2")))
            .select(*df.columns, (F.col("_off") + F.col("_lrn")).alias(out)))


def _pieces(df: DataFrame, order: list[str], group: list[str], pieces: int | None) -> DataFrame:
    """The rows, written in ``pieces`` range partitions (by default the session's shuffle
    partitions), with their group ``_g``, piece ``_b`` and place in the piece ``_at``."""
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = staged(df, "to-number")       # the range bounds are a sample: a pass of their own
    # the piece and the place are part of the written rows, so all readers see the same cut
    return staged(df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
                  .withColumns({"_g": F.struct(F.lit(0).alias("_z"), *group), "_b": F.spark_partition_id(),
                                "_at": F.monotonically_increasing_id().bitwiseAND(_IN_PARTITION)}), "numbered")


def _with_offsets(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    return rows.join(offsets, (F.col("_g") == F.col("_g2")) & (F.col("_b") == F.col("_b2")))


def _before(value: str) -> Column:
    """The sum of ``value`` over the earlier pieces of the group."""
    w = Window.partitionBy("_g2").orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def number_rows_once(df: DataFrame, order: list[str], group: list[str] | None = None, out: str = "rn",
                     pieces: int | None = None) -> DataFrame:
    """``number_rows`` in ``pieces`` range partitions."""
    rows = _pieces(df, order, group or [], pieces)
    offsets = (rows.groupBy(F.col("_g").alias("_g2"), F.col("_b").alias("_b2"))
               .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
               .select("_g2", "_b2", (_before("_n") - F.col("_first")).alias("_off")))
    return _with_offsets(rows, offsets).select(*df.columns, (F.col("_off") + F.col("_at") + 1).alias(out))


def sums_before_once(df: DataFrame, order: list[str], values: dict[str, str], group: list[str] | None = None,
                     pieces: int | None = None) -> DataFrame:
    """Adds a column per entry of ``values`` (name -> column): its sum over the rows before
    this one, in the order, of the group.  Sums of whole numbers are exact."""
    rows = _pieces(df, order, group or [], pieces)
    inside = Window.partitionBy("_g", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_l_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()})
    offsets = (rows.groupBy(F.col("_g").alias("_g2"), F.col("_b").alias("_b2")).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
               .select("_g2", "_b2", *[_before(f"_t_{k}").alias(f"_o_{k}") for k in values]))
    return _with_offsets(local, offsets).select(*df.columns, *[(F.col(f"_o_{k}") + F.col(f"_l_{k}")).alias(k) for k in values])


def prefix_sums(df: DataFrame, key: str, bucket: Column, order: list[str],
                values: dict[str, Column]) -> DataFrame:
    """Adds one running-sum column per entry of ``values`` (name -> integer column),
    inclusive of the current row, per ``key`` in ``order``."""
    return add_prefix_sums(with_bucket(df, key, bucket), order, values).drop("_k", "_b")


def with_bucket(df: DataFrame, key: str, bucket: Column) -> DataFrame:
    """``df`` with the partitioning columns of ``add_prefix_sums``."""
    return df.withColumns({"_k": F.struct(key), "_b": F.coalesce(bucket, F.lit(-2 ** 62))})


def add_prefix_sums(src: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Stacked passes keep ``_k`` and ``_b``, and so the exchange of the first one."""
    names = list(values)
    v = src.withColumns({f"_v_{k}": x for k, x in values.items()})
    inside = Window.partitionBy("_k", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = v.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(inside) for k in names})
    earlier = Window.partitionBy("_k2").orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (v.groupBy(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"))
               .agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in names])
               .select("_k2", "_b2", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in names]))
    out = local.join(by_merge(offsets), (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2")))
    return out.select(*src.columns, *[(F.col(f"_o_{k}") + F.col(f"_l_{k}")).alias(k) for k in names])
