"""Line deduplication with two Bloom filters.

1. Each task hashes its documents' distinct line keys and sends the 8-byte hashes, packed,
   to the chunk of the filters that owns them.  No text moves.
2. A chunk's task streams the hashes through two bitmaps, once-seen and twice-seen: a hash
   whose once-bits are all set already sets its twice-bits.  Both are sized from the
   counted number of hashes, so their load does not grow with the corpus.
3. The twice-seen bitmaps are broadcast.  Their total size is checked: beyond
   ``broadcast_bytes`` they are folded in half until they fit, which lets more
   keys through and never fewer, so the result does not depend on it.
4. Only suspected repeats, keys all of whose twice-bits are set, are shuffled as text, for
   the exact count of documents and the choice of the first one.
5. Documents lose the lines of the confirmed keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import WS_CHARS, cut, fresh, key_id, key_text, with_keys, written
from .lines import line_key, split_lines, without

_WS = WS_CHARS.encode()
_PROBES = 3
_BITS_PER_KEY = 10


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    """Distinct line keys of at least ``min_chars`` code points."""
    keys = {line.strip(_WS).lower() for line in text.split(b"\n")}
    if min_chars <= 1:
        keys.discard(b"")
        return keys
    return {k for k in keys if len(k.decode("utf-8", "replace")) >= min_chars}


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(k, 7) for k in keys), dtype=np.uint64)


def _chunk_of(h: np.ndarray, chunks: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(chunks)).astype(np.int64)


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bit positions of each hash in its chunk; ``bits`` is a power of two, so the
    positions in a folded bitmap are these modulo its size."""
    with np.errstate(over="ignore"):
        a = h * np.uint64(0x9E3779B97F4A7C15)
        b = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
        return [(((a + np.uint64(i) * b) >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64) for i in range(_PROBES)]


def _have(bitmap: np.ndarray, pos: list[np.ndarray]) -> np.ndarray:
    ok = np.ones(len(pos[0]), bool)
    for p in pos:
        ok &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return ok


def _set(bitmap: np.ndarray, pos: list[np.ndarray]) -> None:
    for p in pos:
        np.bitwise_or.at(bitmap, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))


def _send_hashes(chunks: int, min_chars: int):
    def run(batches):
        for b in batches:
            parts = [_hashes(keys_of(t, min_chars)) for t in b.column("text").to_pylist()]
            h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            if not len(h):
                continue
            c = _chunk_of(h, chunks)
            order = np.argsort(c, kind="stable")
            h, c = h[order], c[order]
            cuts = np.flatnonzero(np.diff(c)) + 1
            first = np.concatenate([[0], cuts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[first].astype(np.int32)), pa.array([x.tobytes() for x in np.split(h, cuts)], pa.binary()),
                 pa.array(np.diff(np.concatenate([first, [len(h)]])))], ["chunk", "hashes", "n"])
    return run


def _filter_chunks(bits: int, folded: int):
    """Streams one chunk's packed hashes at a time; gives its folded twice-seen bitmap."""
    def done(chunk, twice):
        out = twice
        while len(out) * 8 > folded:
            half = len(out) // 2
            out = out[:half] | out[half:]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([out.tobytes()], pa.binary())],
                                          ["chunk", "bitmap"])

    def run(batches):
        now, once, twice = None, None, None
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("hashes").to_pylist()):
                if chunk != now:
                    if now is not None:
                        yield done(now, twice)
                    now, once, twice = chunk, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                h, n = np.unique(np.frombuffer(blob, np.uint64), return_counts=True)
                pos = _positions(h, bits)
                again = (n > 1) | _have(once, pos)
                _set(twice, [p[again] for p in pos])
                _set(once, [p[~again] for p in pos])
        if now is not None:
            yield done(now, twice)
    return run


def twice_seen(rows: DataFrame, min_chars: int, broadcast_bytes: int):
    """(chunks, bits per chunk, bitmaps by chunk) over the ``text`` column of ``rows``."""
    spark = rows.sparkSession
    chunks = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = written(rows.select("text").mapInArrow(_send_hashes(chunks, min_chars), "chunk int, hashes binary, n long"),
                   "line-hashes")
    total = sent.agg(F.sum("n")).first()[0] or 0
    bits = 1 << max(10, int(_BITS_PER_KEY * total / chunks).bit_length())
    folded = bits
    while chunks * folded // 8 > broadcast_bytes and folded > 64:
        folded //= 2
    made = (sent.select("chunk", "hashes").repartition("chunk").sortWithinPartitions("chunk")
            .mapInArrow(_filter_chunks(bits, folded), "chunk int, bitmap binary"))
    maps = np.zeros((chunks, folded // 8), np.uint8)
    for chunk, bitmap in made.toLocalIterator():       # at most broadcast_bytes in all
        maps[chunk] = np.frombuffer(bitmap, np.uint8)
    return chunks, folded, maps


def _suspects(maps, chunks: int, bits: int, min_chars: int):
    def run(batches):
        bitmaps = maps.value
        flat = bitmaps.reshape(-1)
        for b in batches:
            ids, ths = b.column("id").to_numpy(), b.column("th").to_numpy()
            keys, row = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                k = keys_of(t, min_chars)
                keys += k
                row += [i] * len(k)
            if not keys:
                continue
            h = _hashes(keys)
            base = _chunk_of(h, chunks) * bits
            hit = np.flatnonzero(_have(flat, [p + base for p in _positions(h, bits)]))
            if len(hit):
                at = np.array(row)[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in hit], pa.binary()), pa.array(ids[at]), pa.array(ths[at])], ["key", "id", "th"])
    return run


def confirmed(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str, broadcast_bytes: int):
    """(suspects, repeated): suspected (key, id, th), and the keys found in at least
    ``min_docs`` documents with the first of them."""
    rows = with_keys(docs, id_col, text_col)
    chunks, bits, maps = twice_seen(rows, min_chars, broadcast_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    sus = written(rows.mapInArrow(_suspects(shared, chunks, bits, min_chars), "key binary, id long, th long"), "suspects")
    no_id = F.col("id") == key_id(F.lit(None))
    per_doc = (sus.groupBy("key", "id", F.when(no_id, F.col("th")).alias("own"))
               .agg(F.min("th").alias("th")))           # rows without id are told apart by text
    repeated = (per_doc.groupBy("key").agg(F.count(F.lit(1)).alias("docs"),
                                           F.min(F.struct(no_id.alias("none"), "id", "th")).alias("first"))
                .filter(F.col("docs") >= min_docs))
    # cut, so the join that follows has a shuffle of its own that Spark can split at a hot key
    return sus, cut(repeated)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id",
                text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """All columns of ``docs`` with the text column replaced, and n_lines, n_dropped (fresh
    names are given if ``docs`` has such columns: see ``out_names``).

    A key found in at least ``min_docs`` documents loses all its lines (``keep="none"``), or
    all but those in its first document (``keep="first"``: smallest id, null last, then text
    hash).  Null text is one empty line; an empty key is never dropped.  Rows sharing an id
    are one document; rows without an id are told apart by their text.  Texts and lines of any
    length are read whole; other columns, whatever their names, come back as they were; an
    empty table gives an empty result.
    """
    sus, repeated = confirmed(docs, min_docs, min_chars, id_col, text_col, broadcast_bytes)
    hit = sus.join(repeated, "key")
    if keep == "first":
        hit = hit.filter((F.col("first.id") != F.col("id")) | (F.col("first.th") != F.col("th")))
    drops = hit.groupBy("id", "th").agg(F.collect_set(F.col("key").cast("string")).alias("keys")).alias("x")
    n_lines, n_dropped = out_names(docs)
    d = docs.alias("d")
    text = F.col(f"d.`{text_col}`")
    i, t = key_id(F.col(f"d.`{id_col}`")), key_text(F.col(f"d.`{id_col}`"), text)
    joined = d.join(drops, (i == F.col("x.id")) & (t == F.col("x.th")), "left")
    drop = F.col("x.keys")
    new = without(text, drop, line_key)
    count = F.when(drop.isNull(), F.lit(0)).otherwise(F.size(F.filter(
        split_lines(text), lambda line: F.array_contains(drop, line_key(line)))))
    keep_cols = [new.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*keep_cols, F.size(split_lines(text)).cast("long").alias(n_lines),
                         count.cast("long").alias(n_dropped))


def out_names(docs: DataFrame) -> tuple[str, str]:
    return fresh(docs, "n_lines"), fresh(docs, "n_dropped")
