"""The quality classifier: its parts by brute force, its verdicts by held-out labels."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import classifier
from tessera.llm.classifier import ClassifierParams
from tessera.llm.queries import op13_quality_classifier

from .conftest import frame

P = ClassifierParams(bits=6, dims=8, epochs=10)


def naive_words(text):
    out, run = [], ""

    def kind(c):
        return "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else "_" if c == "_" else "p"
    for c in text or "":
        if run and kind(c) == kind(run[-1]) and kind(c) != "s":
            run += c
        else:
            out, run = out + [run] * (run.strip() != ""), c
    return out + [run] * (run.strip() != "")


def naive_sums(texts, p):
    index = classifier.index_vectors(p)
    sums, n = defaultdict(lambda: np.zeros(p.dims, int)), defaultdict(int)
    for t in texts:
        w = [zlib.crc32(x.encode()) & ((1 << p.bits) - 1) for x in naive_words(t)]
        for i, x in enumerate(w):
            n[x] += 1
            for j in range(max(0, i - p.reach), min(len(w), i + p.reach + 1)):
                if j != i:
                    sums[x] += index[w[j]]
    return sums, n


def test_word_sums_by_brute_force(spark, docs, corpus):
    want, n = naive_sums([t for _, t, _ in corpus], P)
    got = {r.word: (r.n, [r[f"s{d}"] for d in range(P.dims)]) for r in classifier.word_sums(docs, P).collect()}
    assert got == {w: (n[w], want[w].tolist()) for w in n}


@pytest.mark.parametrize("piece,add_at", [(1 << 20, 1 << 17), (9, 3), (2, 1), (40, 7)])
def test_pieces_change_nothing(corpus, piece, add_at, monkeypatch):
    """Texts read in pieces of a few characters, contexts added a few words at a time."""
    monkeypatch.setattr(classifier, "_PIECE", piece)
    monkeypatch.setattr(classifier, "_ADD_AT", add_at)
    texts = ["", "one", "a b c d e f g h i j k", "x x, y! 12_12 ..", " \t\n", "in\u2003between" * 9, corpus[2][1], corpus[9][1]]
    words, adder = classifier._Words(P.bits), classifier.ContextSums(P)
    vectors = np.random.default_rng(0).normal(size=(64, 8))
    for t in texts:
        assert [x for part in words.of(t) for x in part] == [zlib.crc32(w.encode()) & 63 for w in naive_words(t)]
        for part in words.of(t):
            adder.add(part)
        adder.end()
        v = vectors[[x for part in words.of(t) for x in part]].reshape(-1, 8)
        m = max(1, len(v))
        dots = [[float(a @ b) for a, b in zip(v, v[d:])] for d in (1, 2)]
        near = [f for d in dots for f in (sum(d) / m, sum(x ** 4 for x in d) / m)]
        want_x = np.concatenate([v.sum(axis=0) / m, (v ** 2).sum(axis=0) / m, near, [np.log1p(len(v))]])
        assert classifier.pool(words.of(t), vectors, 2) == pytest.approx(want_x)
    want, n = naive_sums(texts, P)
    count, sums = adder.result()
    assert dict(enumerate(count.tolist())) == {w: n[w] for w in range(64)}
    assert all(sums[:, w].tolist() == want[w].tolist() for w in range(64))


def test_temperature_calibrates_and_fit_learns():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(4000, 5))
    p_true = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rnd.random(4000) < p_true).astype(float)
    net = classifier.fit(x[:3000], y[:3000], P)
    s = net.scores(x[3000:])
    assert np.abs(s - p_true[3000:]).mean() < 0.08
    for low in np.arange(0, 1, 0.25):
        part = (s >= low) & (s < low + 0.25)
        assert abs(s[part].mean() - y[3000:][part].mean()) < 0.12
    again = classifier.fit(x[:3000], y[:3000], P)
    assert (again.scores(x) == net.scores(x)).all()
    assert classifier.fit(x[:0], y[:0], P) is None
    for label in (0.0, 1.0):
        few = classifier.fit(x[:3], np.full(3, label), P).scores(x[:3])
        assert np.isfinite(few).all() and (np.abs(few - label) < 0.5).all()


def test_rows_and_labels(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0), (None, 1), (3, None), (208, 0), (140, 1), (99999, 1)],
                                   "doc_id long, quality int")
    out, net = classifier.quality_scores(docs, labels, F.lit(True), P)
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _, _ in corpus)
    assert net is not None and all(0 <= r.score <= 1 for r in got)
    x, y = classifier.labelled(spark.createDataFrame([(0, [0.0] * classifier.n_features(P)), (2, [1.0] * classifier.n_features(P)),
                                                      (2, [1.0] * classifier.n_features(P))], "doc_id long, x array<double>"), labels, P)
    assert sorted(y) == [0.5, 1.0] and x.shape == (2, classifier.n_features(P))
    same = defaultdict(set)
    text_of = defaultdict(set)
    for i, t, _ in corpus:
        text_of[i].add(t or "")
    for r in got:
        same[r.doc_id].add(r.score)
    assert all(len(same[i]) == 1 for i in text_of if i is not None and len(text_of[i]) == 1)
    none, net = classifier.quality_scores(docs, labels.filter("false"), F.lit(True), P)
    assert net is None and {r.score for r in none.collect()} == {0.5}
    assert classifier.quality_scores(empty, labels, F.lit(True), P)[0].count() == 0


def test_held_out_documents(spark):
    """Labels of the held-out fifth are never learnt and are predicted."""
    sf = "/root/testdata/sf0.01"
    got = op13_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out]
    assert len(test) > 50 and sum(r.predicted == r.quality for r in test) >= 0.95 * len(test)
    good, bad = ([r.score for r in test if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_query_reads_no_other_column(spark, corpus, tmp_path):
    """Scores do not move when labels of held-out rows, lang, source and ids' order change."""
    rows = [(i, t, s) for i, t, s in corpus if i is not None]
    lab = [(i, i % 2) for i, _, _ in rows]
    for name, flip, source in (("a", 0, None), ("b", 1, "z")):
        frame(spark, [(i, t, source or s) for i, t, s in rows]).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        held = [(i, q ^ flip if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in lab]
        spark.createDataFrame(held, "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    a, b = (sorted(map(tuple, op13_quality_classifier(spark, f"{tmp_path}/{n}").collect())) for n in "ab")
    assert a == b
