"""Backward as-of lookup with a tolerance, without pairs.

For every left row, the right row of the same key with the greatest
``(time, *order)`` in ``[left time - tolerance, left time]``, else NULL.

Every candidate of a left row in tolerance bucket ``b = floor(t / tolerance)``
lies in bucket ``b`` or ``b - 1``.  So each right row is emitted into its own
bucket and the next one, the left rows into their own, and a running ``max``
ordered by (time, right-before-left) inside each (key, bucket) answers every left
row.  One hash exchange on (key, bucket), each input row gives at most two rows,
nothing is paired, and a key holding a third of all rows is spread over its time
buckets: a group holds one key's rows of two tolerance windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
                  order: list[str], values: list[str], tolerance: int, out: str = "match") -> DataFrame:
    """``left`` plus a struct column ``out`` = (t, *order, *values) of the matching
    right row; integer times, ``tolerance`` > 0 in the same unit."""
    assert tolerance > 0
    lcols = left.columns
    lt, rt = F.col(left_time), F.col(right_time)
    lhs = left.select(F.col(key).alias("_k"), F.floor(lt / tolerance).alias("_b"), lt.alias("_t"),
                      F.lit(1).alias("_side"), *[F.col(c).alias(f"_l_{c}") for c in lcols])
    rb = F.floor(rt / tolerance)
    # a NULL key matches nothing, as in an equi-join
    rhs = right.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.explode(F.array(rb, rb + 1)).alias("_b"), rt.alias("_t"),
                       F.lit(0).alias("_side"),
                       F.struct(rt.alias("t"), *order, *values).alias("_r"))
    running = (Window.partitionBy("_k", "_b").orderBy("_t", "_side")
               .rowsBetween(Window.unboundedPreceding, 0))
    u = lhs.unionByName(rhs, allowMissingColumns=True).withColumn("_m", F.max("_r").over(running))
    near = F.col("_m.t") >= F.col("_t") - F.lit(tolerance)
    return (u.filter(F.col("_side") == 1)
            .select(*[F.col(f"_l_{c}").alias(c) for c in lcols], F.when(near, F.col("_m")).alias(out)))
