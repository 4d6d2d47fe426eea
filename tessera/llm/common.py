"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, scratch_path

#: The white space that separates words: space and the code points 9 to 13.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"

_NULL_ID = -(2 ** 63)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, in the shared checkpoint folder, so a
    lost executor costs a re-read and not a re-computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut`` for wide rows: a compressed Parquet table below the shared folder."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` with the table's path, for ``remove`` once nothing reads the table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that a later, complete one has replaced."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def key_id(doc_id: Column) -> Column:
    """doc_id for equi-joins: a null becomes a value of its own."""
    return F.coalesce(doc_id.cast("long"), F.lit(_NULL_ID))


def key_text(doc_id: Column, text: Column) -> Column:
    """Tells apart rows that share a doc_id (or have none) but differ in text.  Rows
    equal in both are the same document to every operator here."""
    return F.xxhash64(text, doc_id.isNull())


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, text) with text as UTF-8 bytes; null text as empty."""
    i, t = docs[id_col], docs[text_col]
    return docs.select(key_id(i).alias("id"), key_text(i, t).alias("th"),
                       F.coalesce(t, F.lit("")).cast("binary").alias("text"))


def doc_id_of(key: Column) -> Column:
    return F.when(key != F.lit(_NULL_ID), key)


def map_batches(df: DataFrame, fn: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from columns (name -> Arrow array) to columns."""
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(dict(zip(b.schema.names, b.columns)))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([as_array(out[n]) for n in names], names)
    return df.mapInArrow(run, schema)


def as_array(x) -> pa.Array:
    if isinstance(x, pa.ChunkedArray):
        return x.combine_chunks()
    return x if isinstance(x, pa.Array) else pa.array(x)
