"""Quality rules with cross-document line frequency, in built-in functions only.

Base rules look at one document.  The corpus rule hashes every normalised line, whatever its
length, counts in how many distinct documents of a host each stands, removes the lines above
the limit and rejects a document that has too little left.

Exact copies count as one document, on every host and at every size: a page that a host has
ten thousand times says no more about its lines than the page once.  The limit is a number
of documents and does not grow with the host, so the verdict on a set of pages is the same
wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_RE, doc_id_of, key_id, key_text, written
from .lines import let, line_key, split_lines

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    window: int = 8
    max_repeat_pct: int = 30
    max_docs: int = 5              # a line may stand in so many documents of a host
    min_left_pct: int = 30         # of its words a document must keep, and min_words


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WS_RE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WS_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WS_RE)))


def repeated_words(words: Column, k: int) -> Column:
    """Words inside k-word windows that stand twice or more in the array.  Windows are
    compared by a 64-bit hash of their words within one document."""
    def covered(at):
        return F.aggregate(
            at, F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(k), i - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    def repeats(rows):                     # sorted by hash: equal neighbours are repeats
        twice = F.filter(rows, lambda r, j: (
            F.coalesce(F.get(rows, j - 1)["h"] == r["h"], F.lit(False))
            | F.coalesce(F.get(rows, j + 1)["h"] == r["h"], F.lit(False))))
        return covered(F.sort_array(F.transform(twice, lambda r: r["i"])))

    def of_windows(hashes):
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(rows, repeats))

    def of_words(wh):
        starts = F.sequence(F.lit(1), F.size(wh) - (k - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(wh, i, k))), of_windows)
    return F.when(F.size(words) < 2, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)),
            lambda wh: F.when(F.size(wh) <= k, F.lit(0)).otherwise(of_words(wh))))


def base_rules(docs: DataFrame, p: QualityParams, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(docs[text_col], F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w, p.window).cast("long").alias("n_repeat_words")))
    dup = let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rows = docs.select(
        key_id(docs[id_col]).alias("id"), key_text(docs[id_col], docs[text_col]).alias("th"),
        # a generator keeps the structs from being computed once per field
        F.inline(F.array(F.struct(
            of_words.alias("w"), dup.alias("n_dup_lines"),
            F.length(F.translate(t, WS_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols")))))
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_pct * F.col("n_words"))
    return (rows.select("id", "th", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
            .withColumn("base_failed", failed))


def norm_line(line: Column) -> Column:
    """Line key with runs of white space as one space and runs of digits as one 0."""
    return F.regexp_replace(F.regexp_replace(line_key(line), WS_RE, " "), "[0-9]+", "0")


def frequent_lines(docs: DataFrame, p: QualityParams, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, th, words, lines): per document that has lines above the limit, the words in
    them and their distinct hashes."""
    host = docs[host_col]
    lines = docs.select(key_id(docs[id_col]).alias("id"), key_text(docs[id_col], docs[text_col]).alias("th"),
                        F.xxhash64(docs[text_col]).alias("content"), host.alias("host"),
                        F.posexplode(split_lines(docs[text_col])).alias("pos", "line"))
    line = F.col("line")
    # a normalised line has one space between words
    words = F.length(line) - F.length(F.translate(line, " ", "")) + 1
    lines = (lines.withColumn("line", norm_line(line)).filter(line != "")
             .select("id", "th", "content", "host", "pos", F.xxhash64(line).alias("h"), words.alias("words")))
    lines = written(lines, "line-hashes")
    often = (lines.groupBy("host", "h", "content").agg(F.lit(1).alias("one"))
             .groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > p.max_docs)
             .select(F.col("host").alias("often_host"), F.col("h").alias("often_h")))
    hit = lines.join(often, (F.col("h") == F.col("often_h")) & F.col("host").eqNullSafe(F.col("often_host")), "left_semi")
    # repeated rows give the same (id, th, pos) again
    return (hit.groupBy("id", "th", "pos", "h").agg(F.max("words").alias("words"))
            .groupBy("id", "th").agg(F.sum("words").alias("cut_words"), F.collect_set("h").alias("cut_lines")))


def quality(docs: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source") -> DataFrame:
    """One row per input row: id, th, the base figures, base_failed, cut_words (words in
    lines above the limit), cut_lines (their hashes, null if none) and kept.

    Null text is empty and fails (no words).  Texts and lines of any length are read whole.
    Rows without a host form one host, rows without an id are told apart by their text.
    Repeated rows are one document: they count once and get equal verdicts.  An empty table
    gives an empty result; other columns are not read.
    """
    base = base_rules(docs, p, id_col, text_col)
    cuts = frequent_lines(docs, p, id_col, text_col, host_col)
    out = base.join(cuts, ["id", "th"], "left")
    cut = F.coalesce("cut_words", F.lit(0))
    left = F.col("n_words") - cut
    depleted = (cut > 0) & ((left < p.min_words) | (100 * left < p.min_left_pct * F.col("n_words")))
    return (out.withColumn("cut_words", cut)
            .withColumn("kept", ~(F.col("base_failed") | depleted))
            .withColumn("doc_id", doc_id_of(F.col("id"))))


def apply_quality(docs: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source") -> DataFrame:
    """The documents that are kept, without their lines above the limit, and with all their
    columns.  Nulls, long texts, repeated rows and an empty table as in ``quality``."""
    verdict = (quality(docs, p, id_col, text_col, host_col).filter("kept").select("id", "th", "cut_lines")
               .dropDuplicates(["id", "th"]).select(F.col("id").alias("v_id"), F.col("th").alias("v_th"),
                                                    F.col("cut_lines").alias("v_cut")))
    d = docs.alias("d")
    text = F.col(f"d.`{text_col}`")
    key = F.col(f"d.`{id_col}`")
    rows = d.join(verdict.alias("v"), (key_id(key) == F.col("v.v_id")) & (key_text(key, text) == F.col("v.v_th")))

    def stays(line):
        n = norm_line(line)
        return (n == "") | ~F.array_contains(F.col("v.v_cut"), F.xxhash64(n))
    new = F.when(F.col("v.v_cut").isNull(), text).otherwise(F.array_join(F.filter(split_lines(text), stays), "\n"))
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
