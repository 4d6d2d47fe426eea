"""Exact k-means on integer vectors by shallot search.

A vector remembers its nearest and its second-nearest centroid, an upper bound of the
distance to the first and a lower bound of the distance to all others.  After the centroids
have moved, the bounds move by as much, and a vector whose upper bound stays below its
lower bound, or below half the way from its centroid to the next one, is not looked at.
For the others the search starts from the closer of the two remembered centroids and takes
that centroid's neighbours in ascending order.  A centroid that beats the second-nearest
one lies within (distance to the start + second-nearest distance) of the start; this ball
shrinks with every better second, and the first neighbour outside it ends the search.
What survives the bounds is compared by squared distances in integers, so ties are seen
and rounding decides nothing: the bounds only ever rule out with a margin.

Vectors are packed into blocks of at most ``BLOCK`` per row, with their state and the
block's sums per centroid.  A round reads the blocks of the round before, which it
replaces, and adds up the sums: k x dims numbers reach the driver, whatever the data.

Rows: a vector that is null, has another length, or a null or non-finite component, is left
out (``kept``).  Repeated rows are vectors of their own.  A null id is like an empty one in
the choice of the first centroids; equal ids are ordered by components.  With fewer than k
vectors there are as many centroids as vectors; an empty table gives an empty result.
Ties go to the smaller centroid number.  Other columns are not read.  Squared distances must
fit a long: components of more than about 2^27 after scaling raise an OverflowError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, written_at

BLOCK = 2048
_STATE = np.dtype([("first", "<i4"), ("second", "<i4"), ("upper", "<f8"), ("lower", "<f8")])
_PART = "array<struct<cluster:int,n:long,total:array<long>>>"
#: bounds rule out only with this margin, far above the rounding of a square root or a sum
_REL, _ABS = 1e-9, 1e-6


def kept(vectors: DataFrame, dims: int, vec_col: str = "embedding") -> Column:
    """Whether a vector has ``dims`` finite components."""
    v = vectors[vec_col]
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dims) & ok, F.lit(False))


# ---------------------------------------------------------------- search in one block

@dataclass(frozen=True)
class Centroids:
    """Centroids of a round with what a search needs: their distances, each one's neighbours
    in ascending order, half the way to the nearest, and how far each has moved."""
    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        d = np.sqrt(np.stack([squared(self.at, c) for c in self.at]).astype(float))
        order = np.argsort(d + np.where(np.eye(len(d)) > 0, -1.0, 0.0), axis=1, kind="stable")[:, 1:]
        object.__setattr__(self, "gap", d)
        object.__setattr__(self, "near", order)
        half = d[np.arange(len(d)), order[:, 0]] / 2 if len(d) > 1 else np.full(len(d), np.inf)
        object.__setattr__(self, "half", half)
        # the farthest move of any other centroid
        rank = np.sort(self.moved)[::-1]
        other = np.where(np.arange(len(d)) == np.argmax(self.moved), rank[1] if len(d) > 1 else 0.0, rank[0])
        object.__setattr__(self, "others", other)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances in integers, row by row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def scan_all(x: np.ndarray, cs: Centroids) -> np.ndarray:
    """State of vectors that have none yet: all centroids, in ascending number."""
    n = len(x)
    best, second = np.full(n, 2 ** 63 - 1), np.full(n, 2 ** 63 - 1)
    state = np.zeros(n, _STATE)
    state["second"] = -1
    for j, c in enumerate(cs.at):
        d = squared(x, c)
        first = d < best
        nearer = ~first & (d < second)
        state["second"] = np.where(first & (j > 0), state["first"], np.where(nearer, j, state["second"]))
        second = np.where(first, best, np.where(nearer, d, second))
        state["first"] = np.where(first, j, state["first"])
        best = np.where(first, d, best)
    state["upper"] = np.sqrt(best.astype(float))
    state["lower"] = np.sqrt(second.astype(float)) if len(cs.at) > 1 else np.inf
    return state


def search(x: np.ndarray, state: np.ndarray, cs: Centroids) -> np.ndarray:
    """State after the centroids have moved."""
    out = state.copy()
    if len(cs.at) < 2:
        return out
    a = out["first"]
    out["upper"] += cs.moved[a]
    out["lower"] -= cs.others[a]

    def undecided(rows):
        u = out["upper"][rows]
        return rows[~(u * (1 + _REL) + _ABS < np.maximum(out["lower"][rows], cs.half[out["first"][rows]]))]
    rows = undecided(np.arange(len(x)))
    out["upper"][rows] = np.sqrt(squared(x[rows], cs.at[a[rows]]).astype(float))
    rows = undecided(rows)
    if not len(rows):
        return out
    v, a, b = x[rows], out["first"][rows].astype(int), out["second"][rows].astype(int)
    da, db = squared(v, cs.at[a]), squared(v, cs.at[b])
    closer = (db < da) | ((db == da) & (b < a))
    best, second = np.where(closer, b, a), np.where(closer, a, b)
    best_d, second_d = np.where(closer, db, da), np.where(closer, da, db)
    start, known = best.copy(), second.copy()
    to_start = np.sqrt(best_d.astype(float))
    open_ = np.arange(len(rows))
    for step in range(cs.near.shape[1]):
        j = cs.near[start[open_], step]
        ball = to_start[open_] + np.sqrt(second_d[open_].astype(float))
        inside = cs.gap[start[open_], j] <= ball * (1 + _REL) + _ABS
        open_, j = open_[inside], j[inside]
        if not len(open_):
            break
        new = j != known[open_]
        o, j = open_[new], j[new]
        d = squared(v[o], cs.at[j])
        first = (d < best_d[o]) | ((d == best_d[o]) & (j < best[o]))
        nearer = ~first & (d < second_d[o])
        second[o] = np.where(first, best[o], np.where(nearer, j, second[o]))
        second_d[o] = np.where(first, best_d[o], np.where(nearer, d, second_d[o]))
        best[o], best_d[o] = np.where(first, j, best[o]), np.where(first, d, best_d[o])
    out["first"][rows], out["second"][rows] = best, second
    out["upper"][rows], out["lower"][rows] = np.sqrt(best_d.astype(float)), np.sqrt(second_d.astype(float))
    return out


# ---------------------------------------------------------------- blocks

def to_integers(values: np.ndarray, dims: int, scale: int) -> np.ndarray:
    x = np.floor(scale * values.astype(np.float64)).reshape(-1, dims)
    if x.size and np.abs(x).max() >= math.sqrt(2 ** 61 / dims):
        raise OverflowError("a squared distance between such vectors does not fit a long")
    return x.astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """The components in 2, 4 or 8 bytes each, after one byte that says so."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind[2].encode() + x.astype(kind).tobytes()


def _unpacked(b: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[:1].decode()}", offset=1).reshape(-1, dims).astype(np.int64)


def _parts(x: np.ndarray, cluster: np.ndarray) -> list[dict]:
    order = np.argsort(cluster, kind="stable")
    found, first = np.unique(cluster[order], return_index=True)
    totals = np.add.reduceat(x[order], first, axis=0) if len(found) else []
    n = np.diff([*first, len(order)])
    return [{"cluster": int(c), "n": int(m), "total": t.tolist()} for c, m, t in zip(found, n, totals)]


def _schema(ids: str) -> str:
    return f"ids array<{ids}>, vectors binary, state binary, parts {_PART}"


def _first_round(vectors: DataFrame, ids: str, dims: int, scale: int, cs: Centroids) -> DataFrame:
    part = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = to_integers(b.column(1).flatten().to_numpy(zero_copy_only=False), dims, scale)
                state = scan_all(x, cs)
                own = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array([_packed(x)], pa.binary()), pa.array([state.tobytes()], pa.binary()),
                     pa.array([_parts(x, state["first"])], part)], ["ids", "vectors", "state", "parts"])
    return vectors.mapInArrow(run, _schema(ids))


def _next_round(blocks: DataFrame, ids: str, dims: int, cs: Centroids) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states, parts = [], []
            for packed, state in zip(b.column(1), b.column(2)):
                x = _unpacked(packed.as_py(), dims)
                new = search(x, np.frombuffer(state.as_py(), _STATE), cs)
                states.append(new.tobytes())
                parts.append(_parts(x, new["first"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.binary()), pa.array(parts, b.column(3).type)],
                                             ["ids", "vectors", "state", "parts"])
    return blocks.mapInArrow(run, _schema(ids))


def _assigned(blocks: DataFrame, ids: str, dims: int, cs: Centroids) -> DataFrame:
    """(id, cluster, distance) after one more search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, packed, state in zip(b.column(0), b.column(1), b.column(2)):
                x = _unpacked(packed.as_py(), dims)
                cluster = search(x, np.frombuffer(state.as_py(), _STATE), cs)["first"]
                yield pa.RecordBatch.from_arrays([own.values, pa.array(cluster, pa.int32()), pa.array(squared(x, cs.at[cluster]), pa.int64())],
                                                 ["id", "cluster", "distance"])
    return blocks.mapInArrow(run, f"id {ids}, cluster int, distance long")


def _moved(blocks: DataFrame, at: np.ndarray) -> np.ndarray:
    """Exact floor of the mean of every cluster; an empty one stays.  k x dims sums come back."""
    parts = blocks.select(F.explode("parts").alias("p")).select("p.cluster", "p.n", F.posexplode("p.total").alias("dim", "s"))
    big = "decimal(38,0)"
    sums = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(big)).alias("s"))
    out = at.copy()
    for r in sums.collect():
        out[r.cluster, r.dim] = int(r.s) // r.n
    return out


@dataclass(frozen=True)
class Clustering:
    """``rows``: (id, cluster, distance), one per kept vector; ``centroids``: (k, dims) integers."""
    rows: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 256, seed: int = 2,
            id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering:
    """Starts from the k vectors with the smallest sha256 of ``seed:id`` and assigns and moves
    ``rounds`` times, then assigns once more."""
    src = vectors.filter(kept(vectors, dims, vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    ids = src.schema["id"].dataType.simpleString()
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = src.orderBy(draw, "v").limit(k).collect()
    at = to_integers(np.array([r.v for r in first], dtype=np.float64).reshape(len(first), dims), dims, scale)
    spark = vectors.sparkSession
    if not first:
        return Clustering(spark.createDataFrame([], f"id {ids}, cluster int, distance long"), at)
    cs = Centroids(at, np.zeros(len(at)))
    blocks, path = written_at(_first_round(src, ids, dims, scale, cs), "vectors-0")
    for r in range(rounds):
        new = _moved(blocks, cs.at)
        cs = Centroids(new, np.sqrt(squared(new, cs.at).astype(float)))
        if r + 1 < rounds:
            old = path
            blocks, path = written_at(_next_round(blocks, ids, dims, cs), f"vectors-{r + 1}")
            remove(spark, old)
    rows, _ = written_at(_assigned(blocks, ids, dims, cs), "clusters")
    remove(spark, path)
    return Clustering(rows, cs.at)


def centroid_digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
