"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at the marked places of a fixed mask; words at the other
places do not matter, so a seed survives their substitution.  Seeds of the benchmark items
meet the same seeds of the documents.  A hit fixes an alignment (a diagonal) of item and
document; along it equal words are counted, and the overlap is the longest stretch with at
least ``similarity`` of its words equal.  It counts if it has ``min_words`` words, or
``similarity`` of the words of a shorter item.

The seeds lose no overlap that counts: ``masks_for`` looks for a mask that fits somewhere
between the unequal words, however they are placed, by trying all places.  For passages of
13 words or more and a similarity of 0.8 that is ``10111``: four words, the second place
of five free.

The benchmark is the query set.  It is cut into blocks of bounded size, which is counted
first; each block's seeds are broadcast and all documents pass by it.  Documents are never
shuffled.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_keys
from .license_scan import tokens

_MAX_SPAN, _MAX_WEIGHT = 8, 6         # masks that are tried
_MAX_PATTERNS = 400_000               # places of unequal words that are tried
_BITMAP = 22                          # log2 of the bits of the quick test
_CELLS = 1 << 20                      # words compared at once


def words_needed(n_item: int, min_words: int, similarity: float) -> int:
    """Words an overlap with an item of ``n_item`` words must have."""
    return int(min(min_words, np.ceil(similarity * n_item - 1e-9)))


def _patterns(n: int, k: int) -> np.ndarray:
    """Every way to place k unequal words among n, as bits."""
    rows = np.array(list(combinations(range(n), k)), np.int64).reshape(comb(n, k), k)
    return (np.int64(1) << rows).sum(axis=1)


def _fits(mask: str, n: int, patterns: np.ndarray) -> bool:
    """Whether the mask meets no unequal word at some place of every pattern."""
    care = sum(1 << i for i, c in enumerate(mask) if c == "1")
    left = patterns
    for shift in range(n - len(mask) + 1):
        left = left[left >> shift & care != 0]
    return not len(left)


@lru_cache(maxsize=256)
def masks_for(n_item: int, min_words: int, similarity: float) -> tuple[str, ...]:
    """Masks of which one hits in every overlap that counts with an item of ``n_item`` words:
    the heaviest one, with a free place if there is such a one, that fits all.

    Lengths from ``min_words`` to twice that stand for longer ones: cut into such lengths, one
    part has no greater share of unequal words than the whole.  Where too many places would
    have to be tried (a low similarity), the mask is a run: k unequal words leave k + 1 runs
    of equal ones, the longest of at least (n - k) / (k + 1)."""
    first = max(1, words_needed(n_item, min_words, similarity))
    lengths = range(first, min(n_item, max(first, 2 * min_words - 1)) + 1)
    unequal = {n: int((1 - similarity) * n + 1e-9) for n in lengths}
    if sum(comb(n, k) for n, k in unequal.items()) <= _MAX_PATTERNS and lengths[-1] < 62:
        cases = [(n, _patterns(n, k)) for n, k in unequal.items()]
        inner = ["".join(p) for span in range(min(first, _MAX_SPAN) - 1) for p in product("10", repeat=span)]
        masks = ["1", *("1" + p + "1" for p in inner)]
        masks = [m for m in masks if len(m) <= first and m.count("1") <= _MAX_WEIGHT]
        for mask in sorted(masks, key=lambda m: (-m.count("1"), "0" not in m, len(m), m)):
            if all(_fits(mask, n, p) for n, p in cases):
                return (mask,)
    runs = [-(-(n - k) // (k + 1)) for n, k in ((n, int((1 - similarity) * n + 1e-9)) for n in range(first, n_item + 1))]
    return ("1" * max(1, min(runs)),)


def seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every place where all marked words are known (id > 0)."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids > 0
    ok = known[at[0]:at[0] + n].copy()
    for p in at[1:]:
        ok &= known[p:p + n]
    start = np.flatnonzero(ok)
    h = np.full(len(start), len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for p in at:
            h = (h ^ ids[start + p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return start, h


def longest_overlap(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """[a, b): the longest stretch with at least ``similarity`` of its places true among
    those that begin and end on a true place (the first of equals)."""
    ends = np.flatnonzero(same) + 1
    if not len(ends):
        return 0, 0
    p = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0 - similarity, -similarity))])
    low = np.minimum.accumulate(np.where(same, p[:-1], np.inf))
    first = np.searchsorted(-low, -(p[ends] + 1e-9), side="left")   # earliest true start not above p[b]
    j = int(np.argmax(ends - first))
    return int(first[j]), int(ends[j])


class Items:
    """Seed index of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], min_words: int = 13, similarity: float = 0.8):
        self.vocabulary, self.item_ids, self.words = {}, [], []
        for item, text in items:
            w = tokens(text)
            self.item_ids.append(item)
            self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], dtype=np.int64))
        owners: dict[str, list[int]] = {}
        for k, w in enumerate(self.words):
            for m in masks_for(len(w), min_words, similarity) if len(w) else ():
                owners.setdefault(m, []).append(k)
        self.masks, self.seeds = tuple(owners), []
        for m, own in owners.items():
            found = [(k, *seeds(self.words[k], m)) for k in own]
            h = np.concatenate([f[2] for f in found])
            k = np.concatenate([np.full(len(f[1]), f[0]) for f in found])
            at = np.concatenate([f[1] for f in found])
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _BITMAP, bool)
            bits[(h >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
            self.seeds.append((h[order], k[order], at[order], np.packbits(bits)))

    @property
    def tables(self) -> tuple:
        first = np.cumsum([0, *map(len, self.words)])
        flat = np.concatenate([np.empty(0, np.int64), *self.words])
        return self.masks, self.vocabulary, self.item_ids, flat, first, self.seeds


def _enough_equal(ids: np.ndarray, k: np.ndarray, shift: np.ndarray, flat: np.ndarray, first: np.ndarray,
                  min_words: int, similarity: float) -> np.ndarray:
    """The alignments with as many equal words as the shortest overlap that counts has."""
    a = np.maximum(0, -shift)
    n = np.minimum(first[k + 1] - first[k], len(ids) - shift) - a
    need = np.ceil(similarity * np.minimum(min_words, np.ceil(similarity * (first[k + 1] - first[k]) - 1e-9)) - 1e-9)
    ends, out, lo = np.cumsum(n), [np.empty(0, np.int64)], 0
    while lo < len(k):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + _CELLS, "right")))
        of = n[lo:hi]
        start = ends[lo:hi] - of - done
        step = np.arange(of.sum()) - np.repeat(start, of)
        same = (flat[np.repeat(first[k[lo:hi]] + a[lo:hi], of) + step]
                == ids[np.repeat(shift[lo:hi] + a[lo:hi], of) + step])
        out.append(lo + np.flatnonzero(np.add.reduceat(same, start, dtype=np.int64) >= need[lo:hi]))
        lo = hi
    return np.concatenate(out)


def overlaps(text: bytes, tables: tuple, min_words: int, similarity: float) -> list[tuple]:
    """(item, start, n_words, n_equal): the best overlap of a document with each item."""
    masks, vocabulary, item_ids, flat, first, index = tables
    get = vocabulary.get
    w = tokens(text)
    ids = np.fromiter((get(x, 0) for x in w), dtype=np.int64, count=len(w))
    span = len(ids) + len(flat) + 1                    # an alignment as one number: item * span + shift + len(flat)
    pairs = []
    for mask, (hashes, owner, place, bits) in zip(masks, index):
        start, h = seeds(ids, mask)
        q = (h >> np.uint64(64 - _BITMAP)).astype(np.int64)
        maybe = np.flatnonzero((bits[q >> 3] >> (7 - (q & 7)).astype(np.uint8)) & 1)
        if not len(maybe):
            continue
        lo, hi = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
        n = hi - lo
        if n.sum():
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.unique(owner[at] * span + np.repeat(start[maybe], n) - place[at] + len(flat)))
    best: dict[int, tuple] = {}
    if pairs:
        owners, shifts = np.divmod(np.unique(np.concatenate(pairs)), span)
        shifts -= len(flat)
        for j in _enough_equal(ids, owners, shifts, flat, first, min_words, similarity):
            k, shift = int(owners[j]), int(shifts[j])
            item = flat[first[k]:first[k + 1]]
            a, b = max(0, -shift), min(len(item), len(ids) - shift)
            x, y = longest_overlap(item[a:b] == ids[a + shift:b + shift], similarity)
            if y - x >= words_needed(len(item), min_words, similarity):
                equal = int((item[a + x:a + y] == ids[a + shift + x:a + shift + y]).sum())
                row = (equal, -(a + shift + x), y - x)
                if row > best.get(k, (0, 0, 0)):
                    best[k] = row
    return [(item_ids[k], -row[1], row[2], row[0]) for k, row in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str):
    """The items, block by block of about ``block_bytes``."""
    b = benchmark.select(F.col(id_col).cast("long").alias("item"),
                         F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = b.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text")
        yield [(r.item, bytes(r.text)) for r in part.toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8,
                 block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id") -> DataFrame:
    """(id, th, item, start, n_words, n_equal): per document and item that overlap, the best
    overlap (most equal words, then first; start and lengths in words of the document).

    Words are runs of letters, digits and code points from 128 on, A-Z lower-cased.  Null
    and empty texts overlap with nothing, texts of any length are read whole.  Items with a
    null id are told apart by their texts and reported with a null item.  Repeated rows are
    reported each; an empty side gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    schema = "id long, th long, item long, start long, n_words long, n_equal long"
    rows, out = with_keys(docs, id_col, text_col), None
    for block in item_blocks(benchmark, block_bytes, item_col, text_col):
        shared = spark.sparkContext.broadcast(Items(block, min_words, similarity).tables)

        def run(batches, shared=shared):
            tables = shared.value
            for b in batches:
                got = []
                for i, t, text in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist()):
                    got += [(i, t, *o) for o in overlaps(text, tables, min_words, similarity)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)],
                                                     ["id", "th", "item", "start", "n_words", "n_equal"])
        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8,
                  block_bytes: int = 4 << 20, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the documents that overlap with a benchmark item: the decision is
    taken where a document is read, so no row is shuffled or joined back.  Items with a null
    id count like the others.  Null and empty texts stay, texts of any length are read whole,
    repeated rows are judged each; other columns come back as they were, whatever their names;
    an empty table stays empty, an empty benchmark removes nothing."""
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, block_bytes, item_col, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, min_words, similarity).tables)

        def run(batches, shared=shared):
            for b in batches:
                clean = [not t or not overlaps(t.encode(), shared.value, min_words, similarity)
                         for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
