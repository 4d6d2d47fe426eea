"""Quality scores from random-indexing word vectors and a small network.

**Words** are runs of letters, of digits, of ``_``, or of other signs; case is kept.  A word
is one of ``2 ** bits`` numbers by its hash, so a vocabulary of any size has a bounded
table.

**Random indexing.**  Every word number has a fixed sparse index vector: ``NONZERO`` entries
of +1 or -1 among ``dims``.  A word's vector is the sum of the index vectors of the words that
stand within ``reach`` places of it, over all documents.  The sums are integers, so they do
not depend on how the documents are split.  Tasks add up their share, Spark adds the shares
per word number, and the table (2^bits x dims numbers) is what reaches the driver.  Columns
are centred over all occurrences and vectors brought to length one.

**Pooling.**  A document is the mean of its words' vectors, their mean square per dimension,
the mean product (and its fourth power) of the vectors of words one to ``reach`` places
apart, which is one where a word repeats, and the logarithm of its number of words (an empty
one: zeros).  These few numbers per document are written once; the network is fitted on some
of them and applied to all.

**Network.**  Two layers in numpy, fitted on at most ``max_rows`` labelled documents (the ones
with the smallest hashes of their ids); a temperature, fitted on a fifth of them that the
layers have not seen, makes the outputs probabilities.

Rows: null texts are empty; empty texts get the score of a document without words.  Texts of
any length are read whole, in pieces.  Repeated rows get equal scores, rows without an id get
a score but never a label.  Labels without an id or value are left out, several labels of an
id count by their mean.  Without labels every score is 0.5.  An empty table gives an empty
result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

NONZERO = 4
_WORD = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")
_SPACE = re.compile(r"\s")
_PIECE = 1 << 20               # characters of a text read at once, up to the next white space
_ADD_AT = 1 << 17              # words whose contexts are added at once


@dataclass(frozen=True)
class ClassifierParams:
    bits: int = 14
    dims: int = 32
    reach: int = 2
    hidden: int = 32
    epochs: int = 60
    max_rows: int = 20_000     # labelled documents that the network is fitted on, at most
    seed: int = 13


def index_vectors(p: ClassifierParams) -> np.ndarray:
    rnd = np.random.default_rng(p.seed)
    out = np.zeros((1 << p.bits, p.dims), np.int8)
    at = np.argsort(rnd.random((1 << p.bits, p.dims)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rnd.choice(np.array([-1, 1], np.int8), at.shape), axis=1)
    return out


class _Words(dict):
    """Word numbers, remembered until there are too many."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        n = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & self.mask
        return n

    def of(self, text: str) -> Iterator[np.ndarray]:
        """The numbers of a text's words, a piece of the text at a time."""
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + _PIECE) if at + _PIECE < len(text) else None
            end = cut.start() if cut else len(text)
            words = _WORD.findall(text, at, end)
            yield np.fromiter(map(self.__getitem__, words), np.int32, len(words))
            at = end


def neighbour_sums(numbers: np.ndarray, index: np.ndarray, reach: int) -> np.ndarray:
    """Per place, the sum of the index vectors within ``reach`` places."""
    own = index[numbers].astype(np.int16)
    out = np.zeros_like(own)
    for d in range(1, reach + 1):
        out[d:] += own[:-d]
        out[:-d] += own[d:]
    return out


class ContextSums:
    """Occurrences and context sums of a stream of documents, whatever pieces it comes in."""

    def __init__(self, p: ClassifierParams):
        # one number more than there are words stands between documents and has no vector
        self.gap, self.reach = np.full(p.reach, 1 << p.bits, np.int32), p.reach
        self.index = np.concatenate([index_vectors(p), np.zeros((1, p.dims), np.int8)])
        self.n, self.sums = np.zeros(len(self.index), np.int64), np.zeros((p.dims, len(self.index)))
        self.waiting, self.size, self.tail = [], 0, self.gap[:0]

    def add(self, numbers: np.ndarray) -> None:
        self.waiting.append(numbers)
        self.size += len(numbers)
        if self.size >= _ADD_AT:
            self.flush()

    def end(self) -> None:
        self.add(self.gap)

    def flush(self) -> None:
        tail, new = self.tail, np.concatenate([self.gap[:0], *self.waiting])
        both = np.concatenate([tail, new])
        rows = neighbour_sums(both, self.index, self.reach)
        rows[:len(tail)] -= neighbour_sums(tail, self.index, self.reach)     # which they got before
        for d in range(len(self.sums)):           # whole numbers below 2^53: exact
            self.sums[d] += np.bincount(both, rows[:, d], len(self.n))
        self.n += np.bincount(new, minlength=len(self.n))
        self.waiting, self.size, self.tail = [], 0, both[len(both) - min(self.reach, len(both)):]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        return self.n[:-1], self.sums[:, :-1]


def word_sums(docs: DataFrame, p: ClassifierParams, text_col: str = "text") -> DataFrame:
    """(word, n, s0, s1, ...): occurrences and context sums of every word number that occurs."""
    names = [f"s{d}" for d in range(p.dims)]
    schema = "word int, n long, " + ", ".join(f"{s} long" for s in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, adder = _Words(p.bits), ContextSums(p)
        for b in batches:
            for text in b.column(0):
                for part in words.of(text.as_py()):
                    adder.add(part)
                adder.end()
        n, sums = adder.result()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), *[pa.array(s[some].astype(np.int64)) for s in sums]],
            ["word", "n", *names])
    parts = docs.select(F.coalesce(docs[text_col], F.lit(""))).mapInArrow(run, schema)
    return parts.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])


def word_vectors(docs: DataFrame, p: ClassifierParams, text_col: str = "text") -> np.ndarray:
    """(2^bits, dims) vectors of length one (zero for a number that does not occur)."""
    out, n = np.zeros((1 << p.bits, p.dims)), np.zeros(1 << p.bits)
    table = word_sums(docs, p, text_col).toArrow()
    at = table.column("word").to_numpy()
    n[at] = table.column("n").to_numpy()
    for d in range(p.dims):
        out[at, d] = table.column(f"s{d}").to_numpy()
    centre = out.sum(axis=0) / max(1.0, n.sum())
    out -= n[:, None] * centre
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def n_features(p: ClassifierParams) -> int:
    return 2 * p.dims + 2 * p.reach + 1


def pool(parts: Iterator[np.ndarray], vectors: np.ndarray, reach: int) -> np.ndarray:
    dims = vectors.shape[1]
    total, square, near, n = np.zeros(dims), np.zeros(dims), np.zeros((reach, 2)), 0
    tail = np.zeros((0, dims), vectors.dtype)
    for numbers in parts:
        v = vectors[numbers]
        total += v.sum(axis=0)
        square += np.einsum("ij,ij->j", v, v)
        n += len(numbers)
        v = np.concatenate([tail, v])
        for d in range(1, reach + 1):          # pairs that end in this piece
            later = v[max(len(tail), d):]
            dot = np.einsum("ij,ij->i", v[len(v) - len(later) - d:len(v) - d], later)
            square_dot = dot * dot
            near[d - 1] += dot.sum(), square_dot @ square_dot
        tail = v[-reach:] if reach else tail
    m = max(1, n)
    return np.concatenate([total / m, square / m, (near / m).ravel(), [np.log1p(n)]])


def pooled(docs: DataFrame, p: ClassifierParams, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): one row per document; ``vectors`` has a bounded size and goes to the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(p.bits)
        for b in batches:
            x = [pool(words.of(t.as_py()), shared.value, p.reach) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])
    src = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, x array<double>")


# ---------------------------------------------------------------- network

@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2
        return _sigmoid(z / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, p: ClassifierParams = ClassifierParams()) -> Network | None:
    """The network of labelled rows; None without any."""
    if not len(x):
        return None
    rnd = np.random.default_rng(p.seed)
    order = rnd.permutation(len(x))
    held, own = (order[::5], np.setdiff1d(order, order[::5])) if len(x) >= 50 else (order, order)
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    xs = (x - mean) / scale
    prior = np.clip(y[own].mean(), 0.01, 0.99)
    w = [rnd.normal(0, x.shape[1] ** -0.5, (x.shape[1], p.hidden)), np.zeros(p.hidden),
         rnd.normal(0, p.hidden ** -0.5, p.hidden), np.array(np.log(prior / (1 - prior)))]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(p.epochs):
        rate = 0.01 * (1 - epoch / p.epochs)
        for rows in np.array_split(rnd.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(xs[rows] @ w[0] + w[1])
            dz = (_sigmoid(h @ w[2] + w[3]) - y[rows]) / len(rows)
            dh = np.outer(dz, w[2]) * (1 - h * h)
            grads = [xs[rows].T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ dz + 1e-4 * w[2], dz.sum()]
            step += 1
            for i, g in enumerate(grads):          # Adam
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    z = np.tanh(xs[held] @ w[0] + w[1]) @ w[2] + w[3]
    grid = np.geomspace(0.25, 8, 61)
    best = min(grid, key=lambda t: _loss(z / t, y[held]))
    return Network(mean, scale, w[0], w[1], w[2], float(w[3]), float(best))


def labelled(rows: DataFrame, labels: DataFrame, p: ClassifierParams, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """At most ``max_rows`` pooled documents with a label, and their labels, on the driver."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
             .groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
             .withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(p.max_rows))
    # repeated rows of a document are one example
    got = (rows.join(known.withColumnRenamed("doc_id", "of_id"), F.col("doc_id") == F.col("of_id"))
           .groupBy("draw", "doc_id", "x").agg(F.max("y").alias("y")).orderBy("draw", "doc_id", "x").limit(p.max_rows)
           .select("x", "y").toArrow())
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features(p))
    return x, np.clip(got.column("y").to_numpy(), 0, 1)


def with_scores(rows: DataFrame, net: Network | None, out: str = "score") -> DataFrame:
    """``rows`` (doc_id, x) -> (doc_id, score)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            s = net.scores(x) if net is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", out])
    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, `{out}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, p: ClassifierParams = ClassifierParams(),
                   label: str = "quality") -> tuple[DataFrame, Network | None]:
    """(doc_id, score) of every document.  ``learn``: which rows of ``labels`` may be learnt."""
    rows = written(pooled(docs, p, word_vectors(docs, p)), "pooled")
    net = fit(*labelled(rows, labels.filter(learn), p, label), p)
    return with_scores(rows, net), net
