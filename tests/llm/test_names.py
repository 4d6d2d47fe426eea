"""Every operator on tables with extra columns of every name that its module uses."""

import ast
import inspect
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.functions import ranking
from tessera.llm import (chat, classifier, common, components, decontam, license_scan, line_dedup, lines, merkle, mixing, quality,
                         queries, shallot, simhash, substring, token_counts, url_filter)

SHARED = (common, components, lines, quality, ranking)
VALUE = "of the table"


def names_in(*modules):
    """Identifiers in the string constants of modules (column names, SQL), without docstrings."""
    found = set()
    for m in (*modules, *SHARED):
        tree = ast.parse(inspect.getsource(m))
        docs = {id(n.body[0].value) for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.FunctionDef, ast.ClassDef)) and n.body
                and isinstance(n.body[0], ast.Expr)}
        for n in ast.walk(tree):
            if isinstance(n, ast.Constant) and isinstance(n.value, str) and id(n) not in docs:
                found |= {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", n.value)}
            if isinstance(n, ast.keyword) and n.arg:
                found.add(n.arg.lower())
    return sorted(found)


def extended(df, *modules):
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(VALUE).alias(n) for n in names_in(*modules) if n not in have])


def rows(df, cols=None):
    return Counter(tuple(map(str, r)) for r in df.select(*[f"`{c}`" for c in cols or df.columns]).collect())


@pytest.fixture(scope="module")
def docs(spark, corpus):
    few = [r for r in corpus if r[1] is None or len(r[1]) < 2500]
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in few], "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def bench(spark, corpus):
    return spark.createDataFrame([(1, corpus[2][1]), (2, None)], "item_id long, text string")


OWN_COLUMNS = {
    "quality": (lambda d, b: quality.quality(d), quality),
    "simhash": (lambda d, b: simhash.near_duplicates(d), simhash),
    "token_counts": (lambda d, b: token_counts.token_counts(d, token_counts.LongestMatch([b" a", b" b", b" w", b"w", b"1"]), prefix=b" "), token_counts),
    "contaminated": (lambda d, b: decontam.contaminated(d, b), decontam),
    "substrings": (lambda d, b: substring.dedup_substrings(d, window=20), substring),
    "mix": (lambda d, b: mixing.mix(d)[0], mixing),
    "license": (lambda d, b: license_scan.license_scan(d, queries.PHRASES, queries.NOTICES), license_scan),
    "merkle": (lambda d, b: merkle.prove(merkle.build(d.select("source", "doc_id", merkle.leaf({c: d[c] for c in merkle.COLUMNS}).alias("leaf")))), merkle),
    "classifier": (lambda d, b: classifier.quality_scores(d, b.select(F.col("item_id").alias("doc_id"), (F.col("item_id") % 2).alias("quality"), "*").drop("item_id")
                                                          if "doc_id" not in b.columns else b.withColumns({"doc_id": F.col("item_id"), "quality": F.col("item_id") % 2}),
                                                          F.lit(True), classifier.ClassifierParams(bits=6, dims=4, epochs=2))[0], classifier),
}


@pytest.mark.parametrize("name", sorted(OWN_COLUMNS))
def test_results_do_not_depend_on_other_columns(name, spark, docs, bench):
    run, module = OWN_COLUMNS[name]
    plain = run(docs, bench)
    wide = run(extended(docs, module), extended(bench, module))
    assert wide.columns == plain.columns and rows(wide) == rows(plain)


KEEPING = {
    "apply_quality": (lambda d, b: quality.apply_quality(d), quality),
    "dedup_lines": (lambda d, b: line_dedup.dedup_lines(d, keep="first"), line_dedup),
    "decontaminate": (lambda d, b: decontam.decontaminate(d, b), decontam),
    **{name: (lambda d, b, stage=stage: stage(d.sparkSession, d, "/root/testdata/sf0.001"), corpus_pipeline)
       for name, stage in corpus_pipeline.STAGES[:-1]},
}


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_other_columns_come_back(name, spark, docs, bench):
    run, module = KEEPING[name]
    modules = (module, line_dedup, simhash, decontam) if module is corpus_pipeline else (module,)
    table = extended(docs, *modules)
    plain, wide = run(docs, bench), run(table, extended(bench, *modules))
    assert rows(wide, docs.columns) == rows(plain, docs.columns)
    extra = [c for c in table.columns if c not in docs.columns]
    same = F.lit(True)
    for c in extra:
        same = same & (wide[f"`{c}`"] == VALUE)
    assert wide.filter(~same).count() == 0


def test_urls_with_a_fitted_model(spark):
    hosts = [("ads", True), ("casino", True), ("garden", False), ("school", False)]
    urls = [(f"http://{h}{i % 7}.example.org/{'x' * (i % 9)}?a={i}", b) for i in range(120) for h, b in hosts]
    stats, model = url_filter.fit(spark.createDataFrame(urls, "url string, blocked boolean"), trees=3)
    assert not isinstance(model, float)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls[:200])] + [(-1, None), (-2, "")], "page_id long, url string")
    table = extended(pages, url_filter).withColumns({c: F.lit(VALUE) for c in ("features", "prediction", "probability", "rawPrediction", "_lex", "_suffix")})
    plain, wide = (url_filter.judge(t, stats, model, ["net/"], ["org/x"]) for t in (pages, table))
    n = url_filter.names(table)
    assert rows(wide, ["page_id", "url", *n.values()]) == rows(plain, ["page_id", "url", *n])
    assert len({r.url_score for r in plain.collect()}) >= 2
    same = F.lit(True)
    for c in [c for c in table.columns if c not in pages.columns]:
        same = same & (wide[f"`{c}`"] == VALUE)
    assert wide.filter(~same).count() == 0 and wide.columns[:len(table.columns)] == table.columns


def test_vectors_and_conversations(spark):
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(40)], "vec_id long, embedding array<double>")
    run = lambda v: shallot.cluster(v, k=4, rounds=3, dims=2).rows            # noqa: E731
    assert rows(run(extended(vectors, shallot))) == rows(run(vectors))
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(4) for t in range(4)],
                                  "conv_id long, turn long, role string, text string")
    run = lambda t: chat.digests(chat.conversations(t))                       # noqa: E731
    assert rows(run(extended(turns, chat))) == rows(run(turns))
