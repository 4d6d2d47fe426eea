"""Shallot search against plain k-means over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import shallot
from tessera.llm.queries import op12_clusters

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, id long, ids string, state binary"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "x", b"y") for i, v in rows], SCHEMA)


def naive(rows, k, rounds, dims, seed=2):
    """[(id, cluster, distance)], centroids"""
    def ok(v):
        return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    data = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if ok(v)]
    first = sorted(data, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in first]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(at)) for _, v in data] if at else []
    for _ in range(rounds):
        best = assign()
        for j in range(len(at)):
            own = [v for (_, v), (_, c) in zip(data, best) if c == j]
            if own:
                at[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(data, assign())), key=str), at


def run(spark, rows, parts=3, **kw):
    got = shallot.cluster(table(spark, rows).repartition(parts), **kw)
    return sorted((tuple(r) for r in got.rows.collect()), key=str), got.centroids.tolist()


def vectors(seed, n, dims, spread=0.2):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    return [(i, [c + rnd.gauss(0, spread) for c in centres[i % 7]]) for i in range(n)]


@pytest.mark.parametrize("seed,n,dims,k,rounds", [(1, 400, 8, 11, 5), (2, 300, 3, 40, 6), (3, 120, 2, 2, 5), (4, 90, 4, 1, 3),
                                                  (5, 30, 5, 40, 5), (6, 200, 1, 9, 8), (7, 50, 6, 5, 0), (8, 60, 6, 5, 1)])
def test_equals_plain_k_means(spark, seed, n, dims, k, rounds):
    rows = vectors(seed, n, dims)
    assert run(spark, rows, k=k, rounds=rounds, dims=dims) == naive(rows, k, rounds, dims)


def test_ties_copies_nulls_and_bad_vectors(spark):
    """Few distinct values, a vector that a third of the rows share, and every kind of bad row."""
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(200)]
    rows += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(100)] + [(3, [9.0, 0.0, 0.0])] * 2 + [(None, [1.0, 2.0, -3.0]), (None, [-0.001, 0.0, 0.0])]
    rows += [(300, None), (301, []), (302, [1.0, 2.0]), (303, [1.0, 2.0, 3.0, 4.0]), (304, [1.0, None, 0.0]),
             (305, [float("nan"), 0.0, 0.0]), (306, [float("inf"), 0.0, 0.0]), (307, [0.0, float("-inf"), 0.0])]
    assert run(spark, rows, k=12, rounds=5, dims=3) == naive(rows, 12, 5, 3)


def test_the_split_does_not_matter(spark):
    rows = vectors(12, 150, 4)
    assert run(spark, rows, parts=1, k=9, rounds=4, dims=4) == run(spark, rows, parts=13, k=9, rounds=4, dims=4)


def test_bounds_spare_most_vectors():
    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.normal(c, 5, (500, 8)) for c in (0, 400, 900, 1500)]).astype(np.int64)
    at = np.stack([x[0], x[500], x[1000], x[1500]])
    state = shallot.scan_all(x, shallot.Centroids(at, np.zeros(4)))
    new = at + 1
    moved = shallot.Centroids(new, np.sqrt(shallot.squared(new, at).astype(float)))
    seen = []
    real, shallot.squared = shallot.squared, lambda a, b: seen.append(len(a)) or real(a, b)
    try:
        got = shallot.search(x, state, moved)
    finally:
        shallot.squared = real
    assert sum(seen) < len(x) / 10 and (got["first"] == np.repeat(np.arange(4), 500)).all()


def test_empty_and_too_large(spark):
    assert run(spark, [], k=3, rounds=2, dims=2) == ([], [])
    assert run(spark, [(1, None)], k=3, rounds=2, dims=2) == ([], [])
    with pytest.raises(OverflowError):
        shallot.to_integers(np.array([1e30, 0.0]), 2, 256)


def test_query_columns(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(64)]) for i in range(70)] + [(70, [0.0] * 63), (71, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, at = naive(rows, 40, 5, 64)
    got = op12_clusters(spark, str(tmp_path)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    total = sum(d for _, _, d in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()
    table(spark, []).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op12_clusters(spark, f"{tmp_path}/none").count() == 0
