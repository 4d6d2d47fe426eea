"""Exact substring dedup: windows of words that stand in an earlier document.

A window is ``window`` consecutive words.  One that also stands in a document with a smaller
id is a repeat; every word under a repeat is removed.

Shards by content.  Among the hashes of a window's ``gram``-word grams the smallest is its
anchor.  Equal windows have equal anchors, so windows are gathered by anchor: consecutive
windows of a document with one anchor form a segment.  Only anchors that occur under two
ids at least can hold a repeat; the segments of all others are never moved.  Equal segments are
one row with their smallest and largest id.

Index.  The segments of a shard (whole anchors, up to ``shard_words`` words) are put into a
compressed FM-index, and all segments are streamed through it: the interval of each window
gives the smallest id it stands in.  What comes back per segment are runs of windows with
that id, and the documents that have the segment compare it with their own.

Hot anchors.  An anchor in more than ``hot_rows`` segments (a passage in a third of all
documents, each with other words around it) could exceed a shard.  Its windows are first
compared by a 128-bit hash, each to a group of its own; windows under one id only are
cut off, and the rest goes on as shorter segments.  This changes where work is done, not
which windows are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import cut, key_id, map_batches, with_keys, written
from .fm_index import FMIndex

_ODD = 0x9E3779B97F4A7C15
_MAX_WINDOWS = 512                 # longer segments are cut: each window stays in one piece


def anchors(words: list[bytes], window: int, gram: int) -> np.ndarray:
    """The anchor hash of every window (empty if there is none)."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    g = np.zeros(len(words) - gram + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            g = (g ^ h[i:len(h) - gram + 1 + i]) * np.uint64(_ODD)
            g ^= g >> np.uint64(32)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    return np.minimum(g[:n], g[width - span:width - span + n])


def segments(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of the segments of a document."""
    a = anchors(words, window, gram)
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64), a
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.concatenate([new, [len(a)]]))
    if size.max() > _MAX_WINDOWS:
        cuts = [np.arange(s, s + n, _MAX_WINDOWS) for s, n in zip(new, size)]
        new = np.concatenate(cuts)
        size = np.diff(np.concatenate([new, [len(a)]]))
    return new, size, a[new]


def _mark(window: int, gram: int):
    def run(batches):
        for b in batches:
            ids, ths = b.column("id").to_numpy(), b.column("th").to_numpy()
            first, size, anchor, row = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                f, n, a = segments(t.split(), window, gram)
                first.append(f)
                size.append(n)
                anchor.append(a)
                row.append(np.full(len(f), i))
            r = np.concatenate(row) if row else np.empty(0, np.int64)
            if len(r):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r]), pa.array(ths[r]), pa.array(np.concatenate(first).astype(np.int32)),
                     pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(anchor).view(np.int64))],
                    ["id", "th", "first", "n", "anchor"])
    return run


def _cut_out(window: int):
    """Documents with their marked segments -> one row per segment with its words."""
    def run(batches):
        for b in batches:
            out = {k: [] for k in ("id", "th", "first", "n", "anchor", "hot", "words", "sid")}
            for i, t, text, marks in zip(b.column("id").to_pylist(), b.column("th").to_pylist(),
                                         b.column("text").to_pylist(), b.column("marks").to_pylist()):
                w = text.split()
                for m in marks:
                    seg = b" ".join(w[m["first"]:m["first"] + m["n"] + window - 1])
                    for k, v in zip(out, (i, t, m["first"], m["n"], m["anchor"], m["hot"], seg, xxh3_128_digest(seg))):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], pa.int64()), pa.array(out["th"], pa.int64()), pa.array(out["first"], pa.int32()),
                 pa.array(out["n"], pa.int32()), pa.array(out["anchor"], pa.int64()), pa.array(out["hot"], pa.bool_()),
                 pa.array(out["words"], pa.binary()), pa.array(out["sid"], pa.binary())], list(out))
    return run


_SEGMENT = "id long, th long, first int, n int, anchor long, hot boolean, words binary, sid binary"


def _strip(hot: DataFrame, window: int) -> DataFrame:
    """Segments of hot anchors, cut down to their windows that stand under two ids."""
    def hashes(batches):
        for b in batches:
            ids, ths, firsts = b.column("id").to_numpy(), b.column("th").to_numpy(), b.column("first").to_numpy()
            h, row, off = [], [], []
            for i, (s, n) in enumerate(zip(b.column("words").to_pylist(), b.column("n").to_pylist())):
                w = s.split()
                h += [xxh3_128_digest(b" ".join(w[k:k + window])) for k in range(n)]
                row += [i] * n
                off += range(n)
            row = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.binary()), pa.array(ids[row]), pa.array(ths[row]), pa.array(firsts[row]),
                 pa.array(off, pa.int32())], ["h", "id", "th", "first", "k"])
    win = written(hot.mapInArrow(hashes, "h binary, id long, th long, first int, k int"), "hot-windows")
    twice = cut(win.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                .filter("lo < hi").select("h"))
    kept = (win.join(twice, "h").groupBy("id", "th", "first")
            .agg(F.sort_array(F.collect_set("k")).alias("ks")))

    def strip(batches):
        for b in batches:
            out = {k: [] for k in ("id", "th", "first", "n", "anchor", "hot", "words", "sid")}
            for r in b.to_pylist():
                w, ks = r["words"].split(), np.array(r["ks"])
                cuts = np.flatnonzero(np.diff(ks) > 1) + 1
                for run in np.split(ks, cuts):
                    seg = b" ".join(w[run[0]:run[-1] + window])
                    row = (r["id"], r["th"], r["first"] + int(run[0]), len(run), r["anchor"], True, seg, xxh3_128_digest(seg))
                    for k, v in zip(out, row):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], pa.int64()), pa.array(out["th"], pa.int64()), pa.array(out["first"], pa.int32()),
                 pa.array(out["n"], pa.int32()), pa.array(out["anchor"], pa.int64()), pa.array(out["hot"], pa.bool_()),
                 pa.array(out["words"], pa.binary()), pa.array(out["sid"], pa.binary())], list(out))
    return hot.join(kept, ["id", "th", "first"]).select(*hot.columns, "ks").mapInArrow(strip, _SEGMENT)


def _index_shards(window: int, shard_words: int):
    """Rows (anchor, words, hi, lo) sorted by anchor -> (sid, a, b, low): windows [a, b) of
    the segment stand in document ``low`` first, and some document after it has them too."""
    def report(segs, lows, highs):
        vocabulary: dict[bytes, int] = {}
        seqs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in s.split()), dtype=np.int64) for s in segs]
        found = FMIndex(seqs, np.array(lows, np.int64), window).search(seqs)
        sid, a, b, low = [], [], [], []
        for s, f, hi in zip(segs, found, highs):
            starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            stops = np.concatenate([starts[1:], [len(f)]])
            use = f[starts] < hi
            if use.any():
                k = int(use.sum())
                sid += [xxh3_128_digest(s)] * k
                a += starts[use].tolist()
                b += stops[use].tolist()
                low += f[starts[use]].tolist()
        return pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                                           pa.array(low, pa.int64())], ["sid", "a", "b", "low"])

    def run(batches):
        segs, lows, highs, total, last = [], [], [], 0, None
        for batch in batches:
            for anchor, s, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("anchor", "words", "lo", "hi"))):
                if anchor != last and total >= shard_words:
                    yield report(segs, lows, highs)
                    segs, lows, highs, total = [], [], [], 0
                segs.append(s)
                lows.append(lo)
                highs.append(hi)
                total += s.count(b" ") + 2
                last = anchor
        if segs:
            yield report(segs, lows, highs)
    return run


def repeats(rows: DataFrame, window: int, gram: int, hot_rows: int, shard_words: int) -> DataFrame:
    """rows (id, th, text) -> (id, th, spans): per document with repeats, the word ranges
    [a, b) that repeated windows cover."""
    marks = written(rows.mapInArrow(_mark(window, gram), "id long, th long, first int, n int, anchor long"), "anchors")
    # cut: the joins' shuffles are then their own, and Spark can split a hot anchor
    shared = cut(marks.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("rows"))
                 .filter("lo < hi").select("anchor", (F.col("rows") > hot_rows).alias("hot")))
    of_doc = (marks.join(shared, "anchor").groupBy("id", "th")
              .agg(F.collect_set(F.struct("first", "n", "anchor", "hot")).alias("marks")))
    segs = written(rows.join(of_doc, ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "th", "text", "marks")
                   .mapInArrow(_cut_out(window), _SEGMENT), "segments")
    hot = segs.filter("hot")
    if not hot.isEmpty():
        segs = segs.filter("not hot").unionByName(written(_strip(hot, window), "hot-segments"))
    distinct = (segs.groupBy("anchor", "words").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                .repartition("anchor").sortWithinPartitions("anchor"))
    found = distinct.mapInArrow(_index_shards(window, shard_words), "sid binary, a int, b int, low long")
    own = segs.select("sid", "id", "th", "first").join(found, "sid").filter("low < id")
    return (own.groupBy("id", "th")
            .agg(F.collect_list(F.struct((F.col("first") + F.col("a")).alias("a"),
                                         (F.col("first") + F.col("b") + (window - 1)).alias("b"))).alias("spans")))


def dedup_substrings(docs: DataFrame, window: int = 50, gram: int = 8, hot_rows: int = 2000, shard_words: int = 1 << 19,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n_words, n_removed, kept) per input row; kept: the words left, joined by one
    space.  Windows are judged on the input, not on what is left.

    Null and empty texts have no words, texts of any length are read whole.  A row without an id is no document before or after
    another and keeps all its words.  Rows that share an id are the same document: they do
    not repeat each other, and each loses what a smaller id has.  An empty table gives an
    empty result; other columns are not read.
    """
    rows = with_keys(docs, id_col, text_col)
    spans = repeats(rows.filter(F.col("id") != key_id(F.lit(None))), window, gram, hot_rows, shard_words)

    def remove(c):
        n, gone, kept = [], [], []
        for text, cut in zip(c["text"].to_pylist(), c["spans"].to_pylist()):
            w = text.split()
            n.append(len(w))
            if cut:
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, [s["a"] for s in cut], 1)
                np.add.at(edge, [s["b"] for s in cut], -1)
                stay = np.cumsum(edge[:-1]) == 0
                gone.append(len(w) - int(stay.sum()))
                w = [w[i] for i in np.flatnonzero(stay)]
            else:
                gone.append(0)
            kept.append(b" ".join(w))
        return {"id": c["id"], "th": c["th"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                "kept": pa.array(kept, pa.binary())}
    return map_batches(rows.join(spans, ["id", "th"], "left").select("id", "th", "text", "spans"), remove,
                       "id long, th long, n_words long, n_removed long, kept binary")
