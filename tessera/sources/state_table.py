"""A state table that is updated in place by rewriting the buckets a batch touches.

The rows lie in hash buckets of their key, one Parquet partition each.  A batch of changes is
reduced to one per key, joined with the rows of its buckets only (partition pruning), and
those buckets are overwritten (Spark's dynamic partition overwrite); the files of all
others stay as they are.  This is the bulk form of an upsert (INSERT ... ON CONFLICT DO
UPDATE), of UPDATE ... FROM and of DELETE ... USING; ``create`` is that of TRUNCATE and INSERT.

Every bucket carries one marker row with the number of the last batch that was applied to
it.  A batch that is delivered again, as ``foreachBatch`` may do, changes nothing, also
where it was cut off between two buckets, and also for changes that add to what is stored.
The marker keeps a bucket whose last row is deleted, too.

One writer at a time; a reader that opened the table before a batch is not kept from the
new files (no isolation, no log).  Choose ``buckets`` so that a bucket stays a small part of
the table: a batch costs the buckets it touches.  NULL keys are a value; a null ``order`` value
is the oldest.  An empty batch touches nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import staged

_BUCKET, _BATCH, _LIVE = "_bucket", "_batch", "_live"


class StateTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], columns: str | T.StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.columns = spark.createDataFrame([], columns).schema
        self.names = self.columns.names
        self._stored = T.StructType([*[T.StructField(f.name, f.dataType) for f in self.columns],
                                     T.StructField(_BATCH, T.LongType()), T.StructField(_LIVE, T.BooleanType()),
                                     T.StructField(_BUCKET, T.IntegerType())])

    # ---- reading -------------------------------------------------------------------
    def _files(self) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(self.path)

    def read(self) -> DataFrame:
        return self._files().filter(_LIVE).select(*self.names)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.struct(*self.key)), F.lit(self.buckets)).cast("int")

    # ---- writing -------------------------------------------------------------------
    def create(self, rows: DataFrame, order: list[str] | None = None) -> None:
        """The table with these rows (one per key) and nothing else."""
        rows = self._last(rows.select(*self.names), order)
        self._write(rows.withColumn(_BUCKET, self.bucket()), self.spark.range(self.buckets).select(F.col("id").cast("int").alias(_BUCKET)),
                    None, "static")

    def merge(self, changes: DataFrame, batch: int, order: list[str] | None = None, delete: str | None = None,
              combine: Callable[[Column, Column], dict[str, Column]] | None = None) -> list[int]:
        """Apply a batch of rows; gives the buckets that were rewritten.

        Of several changes to a key the one with the greatest ``order`` counts, and it counts
        only if it is not older than the stored row.  ``delete``: a boolean column of the
        changes; where it is true the key goes.  ``combine(old, new)``: values of columns
        for a key that is stored already (structs of the table's columns)."""
        rows = self._last(changes.select(*self.names, *([delete] if delete else [])), order)
        rows = staged(rows.withColumn(_BUCKET, self.bucket()), "state-changes")
        # at most one row per bucket comes back, of the changes and of the markers
        touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())
        if not touched:
            return []
        there = self._files().filter(F.col(_BUCKET).isin(touched))
        marks = there.filter(~F.col(_LIVE)).groupBy(_BUCKET).agg(F.max(_BATCH).alias(_BATCH))
        applied = {r[_BUCKET] for r in marks.collect() if r[_BATCH] is not None and r[_BATCH] >= batch}
        open_ = [b for b in touched if b not in applied]
        if not open_:
            return []
        new = rows.filter(F.col(_BUCKET).isin(open_))
        there = there.filter(F.col(_BUCKET).isin(open_))
        merged = staged(self._merged(there.filter(_LIVE), new, order, delete, combine), "state-merged")
        self._write(merged, there.select(_BUCKET).distinct().unionByName(new.select(_BUCKET).distinct()).distinct(), batch, "dynamic")
        return open_

    def _last(self, rows: DataFrame, order: list[str] | None) -> DataFrame:
        """One row per key: the greatest by ``order``, then by all columns."""
        best = F.max_by(F.struct(*rows.columns), F.struct(*(order or []), *[c for c in rows.columns if c not in (order or [])]))
        return rows.groupBy(F.struct(*self.key).alias("_k")).agg(best.alias("_r")).select("_r.*")

    def _merged(self, there, new, order, delete, combine):
        old = there.select(F.struct(*self.key).alias("_k"), F.struct(*self.names).alias("_old"), F.col(_BUCKET).alias("_ob"))
        new = new.select(F.struct(*self.key).alias("_nk"), F.struct(*self.names).alias("_new"), F.col(_BUCKET).alias("_nb"),
                         (F.coalesce(F.col(delete), F.lit(False)) if delete else F.lit(False)).alias("_gone"))
        j = old.join(new, (F.col("_ob") == F.col("_nb")) & (F.col("_k") == F.col("_nk")), "full")
        counts = F.col("_new").isNotNull()
        if order:
            at = [F.struct(*[F.col(s)[c] for c in order]) for s in ("_old", "_new")]
            counts &= F.col("_old").isNull() | (at[1] >= at[0])
        both = F.col("_old").isNotNull()
        merged = combine(F.col("_old"), F.col("_new")) if combine else {}
        values = [F.when(counts & both, merged[c]).when(counts, F.col("_new")[c]).otherwise(F.col("_old")[c]).cast(t.dataType).alias(c)
                  if c in merged else F.when(counts, F.col("_new")[c]).otherwise(F.col("_old")[c]).alias(c)
                  for c, t in zip(self.names, self.columns)]
        # a deletion that is not older takes the key away; one of an unknown key leaves nothing
        return (j.filter(~(counts & F.coalesce(F.col("_gone"), F.lit(False))))
                .select(*values, F.coalesce("_ob", "_nb").alias(_BUCKET)))

    def _write(self, rows: DataFrame, buckets: DataFrame, batch: int | None, mode: str) -> None:
        number = F.lit(batch).cast("long").alias(_BATCH)
        live = rows.select(*self.names, number, F.lit(True).alias(_LIVE), _BUCKET)
        marks = buckets.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.columns], number, F.lit(False).alias(_LIVE), _BUCKET)
        (live.unionByName(marks).hint("rebalance", _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode)
         .partitionBy(_BUCKET).parquet(self.path))
