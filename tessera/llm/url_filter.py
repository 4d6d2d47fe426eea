"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Features of a URL: lengths, depth, digit ratio, character entropy, counts of hyphens, dots
and parameters, and two suffix statistics (how many labelled URLs its domain suffix has and
their share of blocked ones, smoothed).  The statistics are aggregates over all labelled
URLs; for fitting they leave out the fold of the URL's host, so no label explains itself.  The trees are fitted on a bounded sample of them (``per_class`` URLs of each label,
chosen by hash); every URL is judged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("url_chars", "host_chars", "path_chars", "depth", "host_dots", "hyphens", "digit_ratio", "host_digits",
           "entropy", "host_entropy", "n_params", "has_fragment", "longest_label", "vowel_ratio")
SUFFIX = ("suffix_urls", "suffix_blocked")


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is no ://."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule (host and path prefix, as ``example.net/en/``) that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):          # the longest is tested first
        at = rule.find("/")
        h, p = (rule, "") if at < 0 else (rule[:at], rule[at:])
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0


def lexical(url: str | None) -> tuple:
    """The lexical features of one URL, in the order of ``LEXICAL``."""
    url = url or ""
    _, sep, rest = url.partition("://")
    rest = rest if sep else ""
    host = re.match(r"[^/?#]*", rest).group(0).lower()
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    query = rest[len(host) + len(path):].partition("#")[0].lstrip("?")
    letters = sum(c.isalpha() for c in host)
    return (len(url), len(host), len(path), sum(1 for s in path.split("/") if s), host.count("."), host.count("-"),
            sum(c.isdigit() for c in url) / max(len(url), 1), sum(c.isdigit() for c in host), _entropy(rest),
            _entropy(host), sum(1 for q in query.split("&") if q), int("#" in rest),
            max(map(len, host.split("."))), sum(c in "aeiou" for c in host) / max(letters, 1))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in LEXICAL]))
def lexical_udf(urls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tuple(map(float, lexical(u))) for u in urls], columns=list(LEXICAL))


FOLDS = 5


def fold_of(host: Column) -> Column:
    """Hosts are dealt whole, so no label of a host counts in the statistics its URLs are fitted with."""
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame, out_of_fold: bool = False) -> DataFrame:
    """(suffix, suffix_urls, suffix_blocked) over all labelled (url, blocked); with
    ``out_of_fold`` a row per (suffix, fold), over the hosts of all other folds."""
    host = host_of(F.col("url"))
    one, bad = F.lit(1).alias("n"), F.col("blocked").cast("long").alias("b")
    rows = labelled.select(suffix_of(host).alias("suffix"), fold_of(host).alias("own"), one, bad)
    keys = ["suffix"]
    if out_of_fold:
        rows = rows.groupBy("suffix", "own").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        others = F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: f != F.col("own"))
        rows, keys = rows.select("suffix", "n", "b", F.explode(others).alias("fold")), ["suffix", "fold"]
    return (rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
            .select(*keys, F.log2(F.col("n") + F.lit(1.0)).alias("suffix_urls"),
                    ((F.col("b") + 1.0) / (F.col("n") + 2.0)).alias("suffix_blocked")))


def with_features(urls: DataFrame, stats: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, url, features): the columns ``keep`` of ``urls``, which has no others but ``url``
    that a step here could meet; a suffix without statistics is neutral."""
    host = host_of(F.col("url"))
    on = suffix_of(host) == F.col("of_suffix")
    s = stats.withColumnRenamed("suffix", "of_suffix")
    if "fold" in stats.columns:
        on = on & (fold_of(host) == F.col("fold"))
    out = urls.select(*keep, "url", lexical_udf(F.coalesce("url", F.lit(""))).alias("lex"))
    out = out.join(s, on, "left")
    out = out.select(*keep, "url", *[F.col(f"lex.{n}") for n in LEXICAL],
                     F.coalesce("suffix_urls", F.lit(0.0)).alias("suffix_urls"),
                     F.coalesce("suffix_blocked", F.lit(0.5)).alias("suffix_blocked"))
    return VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features").transform(out).select(*keep, "url", "features")


def fit(labelled: DataFrame, per_class: int = 5000, trees: int = 15, depth: int = 4, seed: int = 7):
    """labelled: (url, blocked boolean).  -> (statistics, model); model is a constant 0.0 or
    1.0 where the labels hold one class only (0.0: none at all, nothing is blocked)."""
    known = labelled.filter("url is not null and blocked is not null")
    stats = suffix_statistics(known)
    pick = F.xxhash64("url")
    few = [known.filter(F.col("blocked") == F.lit(x)).distinct().orderBy(pick, "url").limit(per_class) for x in (True, False)]
    sizes = [d.count() for d in few]
    if not all(sizes):
        return stats, 1.0 if sizes[0] else 0.0
    # one sorted partition: sums in a fixed order, so reruns give the same trees
    train = (with_features(few[0].union(few[1]), suffix_statistics(known, out_of_fold=True), ["blocked"])
             .select("url", "features", F.col("blocked").cast("double").alias("label"))
             .coalesce(1).sortWithinPartitions(F.xxhash64("url"), "url").select("features", "label"))
    gbt = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, subsamplingRate=1.0, seed=seed,
                        maxBins=64, cacheNodeIds=False)
    return stats, gbt.fit(train)


def judge(pages: DataFrame, stats: DataFrame, model, block: Sequence[str], allow: Sequence[str], threshold: float = 0.5,
          url_col: str = "url") -> DataFrame:
    """``pages`` with url_host, url_path, url_rule (null if none fits), url_score (the
    model's probability of block) and url_verdict (block or allow).  Fresh names are taken
    where ``pages`` has such columns already: see ``names``.

    A null URL, or one without ://, has empty host and path; no rule fits it and the model
    judges it like any other.  Every row of the table gets its verdict, repeated ones too, and
    URLs of any length are read whole.  Other columns come back as they were, whatever their
    names; an empty table gives an empty result."""
    n = names(pages)
    # the row travels as one value, so no column of it can meet one of a step
    src = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(f"`{url_col}`").alias("url"))
    if isinstance(model, float):
        out = src.withColumn("score", F.lit(model))
    else:
        out = model.transform(with_features(src, stats, ["page"])).withColumn("score", vector_to_array("probability")[1])
    out = out.select("page", "score", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
                     F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    out = out.withColumn("rule", best_rule(F.col("host"), F.col("path"), [*block, *allow]))
    rule = F.col("rule")
    verdict = (F.when(rule.isin(list(block)), "block").when(rule.isNotNull(), "allow")
               .when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(*[F.col("page")[c].alias(c) for c in pages.columns], F.col("host").alias(n["url_host"]),
                      F.col("path").alias(n["url_path"]), rule.alias(n["url_rule"]), F.col("score").alias(n["url_score"]),
                      verdict.alias(n["url_verdict"]))


def names(pages: DataFrame) -> dict[str, str]:
    return {c: fresh(pages, c) for c in ("url_host", "url_path", "url_rule", "url_score", "url_verdict")}


def seed_labels(urls: DataFrame, terms: Sequence[str], url_col: str = "url") -> DataFrame:
    """Labelled URLs from a list of terms: blocked if a host label, cut at hyphens, is a term."""
    host = host_of(F.col(f"`{url_col}`"))
    tokens = F.split(host, "[.-]")
    return urls.select(F.col(f"`{url_col}`").alias("url"),
                       F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms])).alias("blocked"))
