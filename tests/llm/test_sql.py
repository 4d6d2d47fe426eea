"""Registered queries against their DuckDB SQL on the smallest tables, and the pipeline
against a brute-force version of its stages."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm.queries import ORACLE, QUERIES
from tools.check_oracle import rows_of

from .conftest import frame
from .test_brute_force import (A_Z, WS, naive_components, naive_fingerprint, naive_lines, naive_overlaps, naive_quality,
                               naive_targets, words)
from tessera.llm.quality import QualityParams

SF = "/root/testdata/sf0.001"


def test_registered():
    got = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(got)
    assert {int(m[1]) for k in got if (m := re.match(r"op(\d+)_", k))} == set(range(1, 14))
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, duck):
    df = QUERIES[key](spark, SF)
    got = [tuple(r) for r in df.collect()]
    table = {"op2": "pages", "op10": "conversations", "op12": "embeddings"}.get(key.split("_")[0], "documents")
    assert got and len(got) <= 1 + spark.read.parquet(f"{SF}/{table}.parquet").count()
    if key in ORACLE:
        res = duck.sql(ORACLE[key])
        want = res.fetchall()
        assert sorted(df.columns) == sorted(res.columns) and len(got) == len(want)
        assert rows_of(df.columns, got) == rows_of(res.columns, want)


def naive_pipeline(corpus, items):
    p = QualityParams()
    kept = {k[:2]: k for k in naive_quality(corpus, p) if k[-1]}
    seen = defaultdict(set)

    def norm(line):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(WS).translate(A_Z)))
    for _, t, s in corpus:
        for line in (t or "").split("\n"):
            if norm(line):
                seen[s, norm(line)].add(t)
    often = {k for k, v in seen.items() if len(v) > p.max_docs}
    docs = []
    for d, t, s in corpus:
        one = naive_quality_row(corpus, d, t, s, often)
        if one:
            docs.append((d, "\n".join(x for x in t.split("\n") if (s, norm(x)) not in often), s))
    assert kept
    rows = naive_lines_rows(docs)
    comp = naive_components([naive_fingerprint(t) for _, t, _ in rows], list(range(len(rows))))
    best = {}
    for c, (d, t, s) in zip(comp, rows):
        k = (d is None, d if d is not None else 0)
        if c not in best or k < best[c][0]:
            best[c] = (k, (d, t, s))
    rows = [r for _, r in best.values()]

    def tok(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(A_Z))
    rows = [r for r in rows if not any(naive_overlaps(tok(r[1]), tok(i), 13, 0.8) for i in items if i)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    return rows, naive_targets(sizes, (3, 1, 2), 1.5, 2.0)


def naive_quality_row(corpus, d, t, s, often):
    w = words(t)

    def norm(line):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(WS).translate(A_Z)))
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    rep = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(8)}
    cut = sum(len(words(x)) for x in (t or "").split("\n") if (s, norm(x)) in often)
    return not (len(w) < 20 or 100 * len(rep) > 30 * len(w) or cut and (len(w) - cut < 20 or 100 * (len(w) - cut) < 30 * len(w)))


def naive_lines_rows(docs):
    """Rows after line dedup (first document keeps), without the emptied ones."""
    out = []
    for k, n in naive_lines(docs, 10, "first").items():
        d, text, _, dropped = k
        if not (dropped and not words(text)):
            sources = [s for e, t, s in docs if e == d and Counter([(d, text)]) and naive_lines_one(docs, e, t) == text]
            out += [(d, text, sources[0])] * n
    return out


def naive_lines_one(docs, d, t):
    if not hasattr(naive_lines_one, "memo") or naive_lines_one.memo[0] is not docs:
        where = defaultdict(set)
        for e, u, _ in docs:
            for k in {x.strip(WS).translate(A_Z) for x in (u or "").split("\n")} - {""}:
                where[k].add((e is None, e if e is not None else 0, u if e is None else ""))
        naive_lines_one.memo = (docs, {k: min(v)[:2] for k, v in where.items() if len(v) >= 10})
    hot = naive_lines_one.memo[1]
    return "\n".join(x for x in t.split("\n") if (k := x.strip(WS).translate(A_Z)) not in hot or hot[k] == (d is None, d))


def test_pipeline_by_brute_force(spark, corpus, tmp_path):
    # in an empty id's group the text hash decides ties, which the brute force leaves out
    rows = [r for r in corpus if not (r[0] is None and r[1] and len(words(r[1])) > 60)]
    item = " ".join(words(corpus[2][1])[:20])
    frame(spark, rows).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    want, targets = naive_pipeline(rows, [item, ""])
    got = out.collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, len(words(t))) for d, t, s in want)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - x) <= 1 for s, x in targets.items())


def test_pipeline_stages_keep_the_columns(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, empty):
            out = stage(spark, d, SF)
            assert out.columns == d.columns and out.dtypes == d.dtypes, name
            assert out.count() <= d.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
    stay = corpus_pipeline.STAGES[2][1](spark, docs, SF).filter(F.col("doc_id").isin(0, 100, 208))
    assert sorted(r.doc_id for r in stay.collect()) == [0]
