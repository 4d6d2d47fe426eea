"""SimHash near-duplicates by the general pigeonhole principle.

A fingerprint has 64 bits; bit b is set if over half of the document's shingle hashes
have it.  Two fingerprints are linked if they differ in at most ``max_bits`` bits.

Candidates.  The bits are dealt into m partitions.  If partition i gets a threshold t_i
with sum(t_i) = max_bits - m + 1, then any linked pair differs in at most t_i bits of
some partition i (-1 leaves a partition out).  Each distinct fingerprint gets its own
thresholds: the cheapest allocation by dynamic programming over estimated candidate
counts, and probes each partition with every value within t_i bits of its own.
Correlated bits share a partition, which leaves the others close to uniform.
Statistics (bit co-occurrence, byte histograms) are taken over all fingerprints.

Buckets.  A probe and its bucket meet in one group and are compared bit by bit.  A
bucket of more than ``bucket_rows`` rows is dealt into chunks, and its probes go to each
chunk.  Only a spanning set of the links found is written (one per member at most), so a
group of thousands of near copies never becomes all its pairs; no link is lost.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, doc_id_of, map_batches, with_keys
from .components import components, local_stars

BITS = 64
#: Each bit of a byte in a lane of its own, to add up to 255 hashes at once.
_LANES = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text (0 if it has no word)."""
    w = text.lower().split()          # on bytes: A-Z and the six white-space bytes only
    if not w:
        return 0
    if len(w) <= shingle:
        h = np.array([xxh64_intdigest(b" ".join(w), 42)], dtype=np.uint64)
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
        h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), dtype=np.uint64, count=len(w) - shingle + 1)
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(lanes), 255):
        ones += lanes[i:i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp): the row's keys and its fingerprint as a signed long."""
    def run(c):
        fps = np.fromiter((fingerprint(t, shingle) for t in c["text"].to_pylist()), dtype=np.uint64,
                          count=len(c["text"]))
        return {"id": c["id"], "th": c["th"], "fp": fps.view(np.int64)}
    return map_batches(with_keys(docs, id_col, text_col), run, "id long, th long, fp long")


# ------------------------------------------------------------------ partitions

def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _ball(width: int, t: int) -> int:
    return sum(comb(width, d) for d in range(t + 1)) if t >= 0 else 0


def _widths(m: int) -> list[int]:
    return [BITS // m + (i < BITS % m) for i in range(m)]


def _allocations(m: int, max_bits: int):
    """All threshold vectors with the sum the pigeonhole principle needs."""
    def go(i, left):
        if i == m - 1:
            if -1 <= left:
                yield (left,)
            return
        for t in range(-1, left + (m - 1 - i) + 1):
            for rest in go(i + 1, left - t):
                yield (t, *rest)
    return go(0, max_bits - m + 1)


def choose_m(n: int, max_bits: int, probe_cost: float = 5.0) -> int:
    """Number of partitions with the least expected work for n fingerprints: probes
    (each shuffled, hence their weight) plus candidates to verify."""
    def cost(m):
        w = _widths(m)
        return min(sum(_ball(x, t) * (probe_cost + n / 2 ** x) for x, t in zip(w, a)) for a in _allocations(m, max_bits))
    return min(range(1, max_bits + 3), key=cost)


def group_bits(ones: np.ndarray, n: int, m: int) -> np.ndarray:
    """Order of the bits such that consecutive runs of ``_widths(m)`` bits are the
    partitions: grow each from the most correlated pair left."""
    p = ones.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(ones / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, order = set(range(BITS)), []
    for width in _widths(m):
        rest = sorted(left)
        first = max(rest, key=lambda b: (corr[b, rest].max(), -b))
        group = [first]
        left.discard(first)
        while len(group) < width:
            nxt = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.discard(nxt)
        order += group
    return np.array(order)


def _permuted(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.packbits(_bits(fps)[:, order], axis=1, bitorder="little")
    return np.ascontiguousarray(out).view(np.uint64).ravel()


def _blocks(m: int) -> list[list[tuple[int, int]]]:
    """Per partition its (shift, width) blocks of at most 8 bits."""
    out, at = [], 0
    for w in _widths(m):
        out.append([(at + i, min(8, w - i)) for i in range(0, w, 8)])
        at += w
    return out


def _distance_counts(hist: np.ndarray, width: int, top: int) -> np.ndarray:
    """[value, d]: rows whose block differs from value in exactly d bits."""
    v = np.arange(2 ** width, dtype=np.uint16)
    dist = np.bitwise_count(v[:, None] ^ v[None, :])
    return np.stack([(hist[None, :2 ** width] * (dist == d)).sum(axis=1) for d in range(top + 1)], axis=1)


def allocate(perm: np.ndarray, tables: list[list[np.ndarray]], n: int, m: int, max_bits: int,
             probe_cost: float = 5.0) -> np.ndarray:
    """Thresholds per fingerprint and partition: dynamic programming over the estimated
    number of candidates (blocks of a partition taken as independent)."""
    top, need, rows = max_bits, max_bits - m + 1, len(perm)
    span = need + m                     # sums run from -m to need
    best = np.full((rows, span + 1), np.inf)
    best[:, 0 + 0] = 0.0                # index = sum + number of partitions done
    picks = []
    for i, blocks in enumerate(_blocks(m)):
        frac = np.zeros((rows, top + 1))
        frac[:, 0] = 1.0
        for (shift, width), table in zip(blocks, tables[i]):
            own = table[((perm >> np.uint64(shift)) & np.uint64(2 ** width - 1)).astype(np.int64)] / max(n, 1)
            frac = np.stack([sum(frac[:, d] * own[:, k - d] for d in range(k + 1)) for k in range(top + 1)], axis=1)
        width = _widths(m)[i]
        cost = np.zeros((rows, top + 2))
        for t in range(top + 1):
            cost[:, t + 1] = frac[:, :t + 1].sum(axis=1) * n + probe_cost * _ball(width, t)
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
        for j in range(top + 2):        # j = t + 1 is added to the index
            if j > span:
                continue
            cand = best[:, :span + 1 - j] + cost[:, j, None]
            better = cand < new[:, j:]
            new[:, j:][better] = cand[better]
            pick[:, j:][better] = j
        best = new
        picks.append(pick)
    out, at = np.zeros((rows, m), dtype=np.int8), np.full(rows, span)
    for i in reversed(range(m)):
        j = picks[i][np.arange(rows), at]
        out[:, i] = j - 1
        at = at - j
    return out


def _signatures(perm: np.ndarray, thr: np.ndarray, m: int, max_bits: int) -> dict:
    """Rows (part, val, probe, fp): one index row per partition, and the probes."""
    part, val, probe, fp = [], [], [], []
    at = 0
    for i, width in enumerate(_widths(m)):
        own = (perm >> np.uint64(at)) & np.uint64(2 ** width - 1)
        at += width
        groups = [(0, np.ones(len(perm), bool), own)]
        for t in range(max_bits + 1):
            sel = thr[:, i] >= t
            if sel.any():
                for flip in combinations(range(width), t):
                    groups.append((1, sel, own[sel] ^ np.uint64(sum(1 << b for b in flip))))
        for kind, sel, v in groups:
            part.append(np.full(len(v), i, np.int32))
            val.append(v.view(np.int64))
            probe.append(np.full(len(v), kind, np.int32))
            fp.append(perm[sel].view(np.int64))
    return {"part": np.concatenate(part), "val": np.concatenate(val),
            "probe": np.concatenate(probe), "fp": np.concatenate(fp)}


# ------------------------------------------------------------------ probing

def _verify(index: np.ndarray, probes: np.ndarray, owner_lo: np.ndarray, owner_hi: np.ndarray,
            max_bits: int, block: int = 1 << 20):
    """Each probe against index[lo:hi]: the pairs within max_bits."""
    a, b = [], []
    sizes = owner_hi - owner_lo
    ends = np.cumsum(sizes)
    start = 0
    while start < len(probes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + block, side="right")))
        n = sizes[start:stop]
        who = np.repeat(np.arange(start, stop), n)
        off = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        x, y = probes[who], index[owner_lo[who] + off]
        ok = (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
        if ok.any():
            u, v = local_stars(x[ok].view(np.int64), y[ok].view(np.int64))
            a.append(u)
            b.append(v)
        start = stop
    return a, b


def _probe_groups(max_bits: int):
    """Streams rows sorted by (part, val, chunk, probe): of a group only the index rows
    (bounded by the chunk size) are held while its probes pass."""
    def run(batches):
        held_key, held = None, np.empty(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n).to_numpy() for n in ("part", "val", "chunk", "probe", "fp")}
            fps = c["fp"].view(np.uint64)
            key = np.stack([c["part"].astype(np.int64), c["val"], c["chunk"].astype(np.int64)])
            new = np.ones(len(fps), bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            new[0] = held_key is None or tuple(key[:, 0]) != held_key
            group = np.cumsum(new)            # 0: goes on from the batch before
            is_index = c["probe"] == 0
            idx = np.concatenate([held if not new[0] else held[:0], fps[is_index]])
            idx_group = np.concatenate([np.zeros(len(idx) - int(is_index.sum()), group.dtype), group[is_index]])
            pg = group[~is_index]
            lo, hi = np.searchsorted(idx_group, pg, "left"), np.searchsorted(idx_group, pg, "right")
            a, v = _verify(idx, fps[~is_index], lo, hi, max_bits)
            held_key, held = tuple(key[:, -1]), idx[idx_group == group[-1]]
            if a:
                u, w = local_stars(np.concatenate(a), np.concatenate(v))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], ["u", "v"])
    return run


def links(fps: DataFrame, max_bits: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """fps: distinct fingerprints (column fp).  -> (u, v): links that span every group
    of fingerprints connected by at most max_bits differing bits per step."""
    n = fps.count()
    m = choose_m(n, max_bits)

    def cooccur(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = _bits(b.column("fp").to_numpy()).astype(np.float32)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          pa.array(total[i, j])], ["i", "j", "n"])
    ones = np.zeros((BITS, BITS))
    for r in fps.mapInArrow(cooccur, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n")).collect():
        ones[r[0], r[1]] = r[2]            # 64 x 64 at most
    order = group_bits(ones, n, m)
    shapes = _blocks(m)

    def byte_counts(batches):
        total = [np.zeros((len(p), 256), np.int64) for p in shapes]
        for b in batches:
            perm = _permuted(b.column("fp").to_numpy().view(np.uint64), order)
            for i, blocks in enumerate(shapes):
                for k, (shift, width) in enumerate(blocks):
                    v = ((perm >> np.uint64(shift)) & np.uint64(2 ** width - 1)).astype(np.int64)
                    total[i][k] += np.bincount(v, minlength=256)
        rows = [(i, k, v, int(total[i][k, v])) for i in range(m) for k in range(len(shapes[i]))
                for v in np.nonzero(total[i][k])[0]]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                          pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())],
                                         ["p", "k", "v", "n"])
    hist = [np.zeros((len(p), 256)) for p in shapes]
    for r in fps.mapInArrow(byte_counts, "p int, k int, v int, n long").groupBy("p", "k", "v").agg(F.sum("n")).collect():
        hist[r[0]][r[1], r[2]] = r[3]      # at most 64 / 8 + m blocks of 256 values
    tables = [[_distance_counts(hist[i][k], width, max_bits) for k, (_, width) in enumerate(shapes[i])]
              for i in range(m)]

    def emit(c):
        perm = _permuted(c["fp"].to_numpy().view(np.uint64), order)
        return _signatures(perm, allocate(perm, tables, n, m, max_bits), m, max_bits)
    sigs = map_batches(fps, emit, "part int, val long, probe int, fp long")
    big = (sigs.filter("probe = 0").groupBy("part", "val").agg(F.count(F.lit(1)).alias("rows"))
           .filter(F.col("rows") > bucket_rows)
           .select("part", "val", F.ceil(F.col("rows") / bucket_rows).cast("int").alias("chunks")))
    dealt = (sigs.join(big, ["part", "val"], "left")
             .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
             .withColumn("chunk", F.explode(F.when(F.col("probe") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")))
                                            .otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
             .select("part", "val", "chunk", "probe", "fp"))
    groups = dealt.repartition("part", "val", "chunk").sortWithinPartitions("part", "val", "chunk", "probe")
    perm_links = groups.mapInArrow(_probe_groups(max_bits), "u long, v long")
    back = np.argsort(order)

    def restore(c):
        return {k: _permuted(c[k].to_numpy().view(np.uint64), back).view(np.int64) for k in ("u", "v")}
    return map_batches(perm_links, restore, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: (id, th, fp, root, component_id); root is the smallest
    fingerprint of the component.

    Null or wordless text has fingerprint zero and is linked like any other; texts of any
    length are read whole.  A null id
    keeps its row but is never the smallest id of a component (which is null if no
    member has an id).  Repeated rows share fingerprint and component.  An empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    by_fp = cut(rows.groupBy("fp").agg(F.min(doc_id_of(F.col("id"))).alias("low")))
    roots = components(links(by_fp.select("fp"), max_bits))
    label = by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = label.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = label.select("fp", "root").join(lows, "root").select("fp", "root", "component_id")
    return rows.join(of_fp, "fp").select("id", "th", "fp", "root", "component_id")
