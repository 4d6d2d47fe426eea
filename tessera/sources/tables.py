"""Parquet table access.  Reads are lazy; Catalyst prunes columns and pushes
filters into the scan."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_READS: weakref.WeakKeyDictionary[SparkSession, dict] = weakref.WeakKeyDictionary()


def _version(spark: SparkSession, path: str) -> tuple:
    """Modification time and length of the file or folder, from the store's listing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    st = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p)
    return path, st.getModificationTime(), st.getLen()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The schema of a table is read once per session and version of the table; a
    rewritten table is read again."""
    memo = _READS.setdefault(spark, {})
    key = _version(spark, table_path(sf_dir, name))
    if key not in memo:
        memo[key] = spark.read.parquet(key[0])
    return memo[key]
