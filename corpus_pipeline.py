"""From raw documents to a weighted training mix, one written table per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents that stay,
with the columns of ``documents`` (the last stage returns the mix).  ``run`` writes each
stage's rows as Parquet in the shared folder and hands the reread table on, so a lost
executor costs a re-read and never an earlier stage.

Every stage takes null texts as empty, tells rows without a doc_id apart by their text,
passes other columns through, whatever their names, and gives an empty table for an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, line_dedup, mixing, quality, simhash
from tessera.llm.common import doc_id_of, documents, fresh, key_id, key_text, written


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; the others lose their lines
    above the limit.  Repeated rows get equal verdicts and all stay."""
    return _recounted(quality.apply_quality(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 or more documents stay in the first of them only, so no text is
    lost from the corpus; a document that has no word left goes."""
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1, keep="first")
    dropped = [c for c in out.columns if c not in docs.columns][1]
    emptied = (F.col(dropped) > 0) & (quality.n_words_of(F.col("text")) == 0)
    return _recounted(out.filter(~emptied).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of documents linked by 3 or fewer differing
    fingerprint bits: the one with the smallest doc_id (null last), then text key.
    Repeated rows are one document."""
    rows = simhash.near_duplicates(docs, shingle=3, max_bits=3)
    none = F.col("id") == key_id(F.lit(None))
    keep = (rows.groupBy("root").agg(F.min(F.struct(none.alias("none"), "id", "th")).alias("m"))
            .select(F.col("m.id").alias("keep_id"), F.col("m.th").alias("keep_th")))
    i, t = fresh(docs, "key_id"), fresh(docs, "key_text")
    keyed = docs.withColumns({i: key_id(docs.doc_id), t: key_text(docs.doc_id, docs.text)})
    kept = keyed.join(keep, (keyed[i] == keep.keep_id) & (keyed[t] == keep.keep_th), "left_semi")
    return kept.dropDuplicates([i, t]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontam.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and where: doc_id, source, size, source_size, target,
    taken, n_slots, first_slot."""
    rows, _ = mixing.mix(docs, weights=(3, 1, 2), share=1.5, max_repeat=2.0)
    return rows.select(doc_id_of(F.col("id")).alias("doc_id"), "source", "size", "source_size", "target", "taken",
                       "n_slots", "first_slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: DuckDB has no XXH64 with a seed, so the SimHash stage and the whole run have no SQL;
#: tests compare them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}-{name}")
    return docs
