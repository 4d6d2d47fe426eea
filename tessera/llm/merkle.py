"""Merkle manifest of a dataset as a postorder append log, with proofs by closed-form address.

Every row is a leaf.  The leaves of a source, ascending, form a tree: each run of three
neighbours (the last run may be shorter) becomes one node, level by level, up to the
subroot; the subroots form one more tree in the same way, up to the root.

**Builders.**  A tree of any size is cut into aligned blocks of 3^7 leaves.  One builder
takes a block and appends its nodes in the order in which they are completed, which is the
postorder of the subtree.  The nodes on top of the blocks are the leaves of the next layer,
so a source of 10^10 rows needs four layers and no builder ever holds more than a block.

**Addresses.**  In an append log the place of a node follows from the sizes of the complete
subtrees before it (``position``), so nothing is searched: a proof reads the siblings of a
leaf from the segment of its block by their places, and takes the rest of the path from the
path of its block in the layer above.

Rows: nulls in any column are values of their own (``-``), so are empty texts; texts of any
length are hashed whole, by Spark.  Rows with the same id are ordered by their leaf, so
equal rows are equal neighbours, each with a proof of its own; a null id comes first.  Rows
without a source form the first tree.  An empty table gives no tree, no proof and a null
root.  Columns that are not hashed are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import number_rows_once

from .common import map_batches, written

FAN = 3
BLOCK_LEVELS = 7               # a block has 3^7 = 2,187 leaves and 3,280 nodes
_DIGEST = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


# ---------------------------------------------------------------- shape of a tree

def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h, size = 0, 1
    while size < n:
        h, size = h + 1, size * FAN
    return h


def position(level: int, index: int, n: int) -> int:
    """Place (from 0) of node (level, index) in the postorder log of a tree of n leaves.

    After m leaves the log has floor(m / 3^i) nodes of each level i.  A full node is
    appended with its last leaf, after the lower levels and before the higher ones; the
    nodes that the last, short run leaves open are closed at the end, from below."""
    size = FAN ** level
    m = (index + 1) * size
    if m <= n:
        place, s, i = -1, 1, 0
        while s <= m:
            place += m // s if i <= level else (m - 1) // s
            s, i = s * FAN, i + 1
        return place
    full, s, closed = 0, 1, 0
    while s <= n:
        full += n // s
        s *= FAN
    for i in range(1, level):
        closed += n % FAN ** i != 0
    return full + closed


def completion_order(leaves: list[bytes], top: int) -> list[bytes]:
    """Nodes of the tree over ``leaves`` up to level ``top``, appended as they complete."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(top + 1)]

    def append(level: int, digest: bytes) -> None:
        log.append(digest)
        if level < top:
            runs[level].append(digest)
            if len(runs[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        append(level + 1, parent(run))
    for leaf in leaves:
        append(0, leaf)
    for level in range(top):
        if runs[level]:
            close(level)
    return log


def parent(run: list[bytes]) -> bytes:
    """Digests enter a hash as lowercase hex text."""
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


@lru_cache(maxsize=64)
def _addresses(count: int, top: int) -> list[list[int]]:
    """Places of the nodes of each level in a segment over ``count`` leaves."""
    return [[position(lv, j, count) for j in range(-(-count // FAN ** lv))] for lv in range(top + 1)]


# ---------------------------------------------------------------- building

def leaf(row: dict[str, Column]) -> Column:
    """Digest of a row: ``-`` for a null, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
             for v in (row[c].cast("string") for c in COLUMNS)]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


@dataclass(frozen=True)
class Manifest:
    """``trees``: (tree, source, n, subroot), trees numbered from 0 in the order of sources.
    ``layers``: the segments of the append log, lowest first: (tree, block, n, total, top,
    nodes[, rows]).  ``forest``: the same over the subroots.  ``root``: hex, null if empty."""
    trees: DataFrame
    layers: list[DataFrame]
    forest: list[DataFrame]
    root: str | None


_SEGMENT = "tree long, block long, n long, total long, top int, nodes binary"


def _segments(nodes: DataFrame, levels: int, extra: list[str], name: str) -> DataFrame:
    """nodes (tree, idx, n, total, digest, *extra), n of them at this layer of a tree -> one
    row per block; the digests of a block become its segment of the log."""
    width = FAN ** levels
    rows = nodes.select("tree", F.expr(f"idx div {width}").alias("block"), "n", "total",
                        F.struct("idx", "digest", *extra).alias("row"))
    rows = rows.groupBy("tree", "block", "n", "total").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    top = F.least(F.lit(levels), F.expr(f"cast(ceil(round(log({FAN}, n), 9)) as int)"))
    kind = rows.schema["rows"].dataType.simpleString()

    def build(cols):
        tops = cols["top"].to_pylist()
        digests = cols["digests"].to_pylist()
        nodes = [b"".join(completion_order(d, t)) for d, t in zip(digests, tops)]
        return {**cols, "nodes": nodes}
    rows = rows.select("tree", "block", "n", "total", top.alias("top"), "rows", F.col("rows.digest").alias("digests"))
    out = map_batches(rows, build, f"{_SEGMENT}, rows {kind}")
    return written(out if extra else out.drop("rows"), name)


def _top_nodes(segments: DataFrame, levels: int) -> DataFrame:
    """The last node of every segment, as a leaf of the layer above."""
    width = FAN ** levels
    return segments.select("tree", F.col("block").alias("idx"), F.expr(f"ceil(n / {width})").alias("n"), "total",
                           F.substring("nodes", -_DIGEST, _DIGEST).alias("digest"))


def _layers(nodes: DataFrame, largest: int, levels: int, extra: list[str], name: str) -> list[DataFrame]:
    out, width = [], FAN ** levels
    while largest:
        out.append(_segments(nodes, levels, extra if not out else [], f"{name}-{len(out)}"))
        if largest <= width:
            break
        nodes = _top_nodes(out[-1].filter(F.col("n") > width), levels)
        largest = -(-largest // width)
    return out


def _finished(layers: list[DataFrame], levels: int) -> DataFrame | None:
    """(tree, total, digest): the topmost node of every tree."""
    out = None
    for x in layers:
        top = _top_nodes(x.filter(F.col("n") <= FAN ** levels), levels).select("tree", "total", "digest")
        out = top if out is None else out.unionByName(top)
    return out


def build(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> Manifest:
    """``leaves``: (source, doc_id, leaf, ...); other columns ride along to the proofs.

    The driver reads one count per layer and the root, nothing else."""
    extra = [c for c in leaves.columns if c not in ("source", "leaf")]
    rest = [c for c in extra if c != "doc_id"]
    leaves = number_rows_once(leaves, ["doc_id", "leaf", *rest], group=["source"], out="_rank")
    leaves = written(leaves, "manifest-leaves")
    sizes = leaves.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    trees = number_rows_once(sizes, ["source"], out="_rank").select(
        (F.col("_rank") - 1).alias("tree"), F.col("source").alias("of_source"), "total")
    trees = written(trees, "manifest-trees")
    count, largest = trees.agg(F.count(F.lit(1)), F.max("total")).head()
    nodes = leaves.join(trees, F.col("source").eqNullSafe(F.col("of_source"))).select(
        "tree", (F.col("_rank") - 1).alias("idx"), F.col("total").alias("n"), "total", F.col("leaf").alias("digest"), *extra)
    layers = _layers(nodes, largest or 0, levels, extra, "manifest-log")
    if not layers:
        return Manifest(trees.select("tree", F.col("of_source").alias("source"), F.col("total").alias("n"),
                                     F.lit(None).cast("binary").alias("subroot")), [], [], None)
    subroots = _finished(layers, levels)
    forest = _layers(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"),
                                     F.lit(count).cast("long").alias("n"), F.lit(count).cast("long").alias("total"), "digest"),
                     count, levels, [], "manifest-forest")
    root = _finished(forest, levels).head().digest
    named = trees.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    return Manifest(named.select("tree", F.col("of_source").alias("source"), F.col("total").alias("n"), "subroot"),
                    layers, forest, bytes(root).hex())


def log_rows(layers: list[DataFrame], levels: int = BLOCK_LEVELS) -> DataFrame:
    """The append log as rows (tree, place, digest): every node at its place in the postorder
    of its whole tree.  The top of a block stands once, in the segment that built it."""
    out = None
    for k, x in enumerate(layers):
        base = k * levels

        def place(cols, base=base):
            got = {"tree": [], "place": [], "digest": []}
            for tree, block, n, total, top, nodes in zip(*(cols[c].to_pylist() for c in ("tree", "block", "n", "total", "top", "nodes"))):
                width = FAN ** levels
                count = min(width, n - block * width)
                for lv, at in enumerate(_addresses(count, top)):
                    if lv or not base:                      # higher layers repeat the tops below
                        first = block * FAN ** (levels - lv)
                        got["tree"] += [tree] * len(at)
                        got["place"] += [position(base + lv, first + j, total) for j in range(len(at))]
                        got["digest"] += [nodes[_DIGEST * a:_DIGEST * (a + 1)] for a in at]
            return got
        rows = map_batches(x, place, "tree long, place long, digest binary")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- proofs

#: siblings: digests from the leaf's run to the root's, left to right; slots: the own place
#: in each run; widths: the run's size.
_PATH = "siblings binary, slots binary, widths binary"


def path_in_segment(nodes: bytes, count: int, top: int, index: int) -> tuple[bytes, bytes, bytes]:
    """Siblings, slots and widths of leaf ``index`` of a segment over ``count`` leaves."""
    at = _addresses(count, top)
    siblings, slots, widths = [], [], []
    for lv in range(top):
        first = index - index % FAN
        last = min(first + FAN, len(at[lv]))
        for s in range(first, last):
            if s != index:
                siblings.append(nodes[_DIGEST * at[lv][s]:_DIGEST * (at[lv][s] + 1)])
        slots.append(index - first)
        widths.append(last - first)
        index //= FAN
    return b"".join(siblings), bytes(slots), bytes(widths)


def _paths(segments: DataFrame, above: DataFrame | None, levels: int, extra: list[str]) -> DataFrame:
    """(tree, idx, digest, subroot, path columns, *extra) of every leaf of the segments.
    ``above``: (tree, block, subroot, path columns) of the blocks in the layer above."""
    keep = [c for c in segments.columns if c != "rows"]
    x = segments
    if extra:
        x = x.withColumn("extra", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in extra])))
        keep.append("extra")
    if above is not None:
        above = above.select(F.col("tree").alias("u_tree"), F.col("block").alias("u_block"), "subroot", "siblings", "slots", "widths")
        x = x.join(above, (F.col("tree") == F.col("u_tree")) & (F.col("block") == F.col("u_block")), "left")
    else:
        x = x.selectExpr("*", "cast(null as binary) subroot", "X'' siblings", "X'' slots", "X'' widths")
    x = x.select(*keep, "subroot", "siblings", "slots", "widths")
    kind = f", extra {x.schema['extra'].dataType.elementType.simpleString()}" if extra else ""
    fields = ["tree", "idx", "digest", "subroot", "siblings", "slots", "widths"]
    schema = f"tree long, idx long, digest binary, subroot binary, {_PATH}{kind}"
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    width = FAN ** levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                nodes = row["nodes"].as_py()
                tree, block, n, top, sub = (row[c].as_py() for c in ("tree", "block", "n", "top", "subroot"))
                up = [row[c].as_py() or b"" for c in ("siblings", "slots", "widths")]
                count = min(width, n - block * width)
                at = _addresses(count, top)[0]
                got = [[x + y for x, y in zip(path_in_segment(nodes, count, top, i), up)] for i in range(count)]
                own = [nodes[_DIGEST * a:_DIGEST * (a + 1)] for a in at]
                cols = [[tree] * count, list(range(block * width, block * width + count)), own, [sub] * count, *zip(*got)]
                arrays = [pa.array(list(c), t) for c, t in zip(cols, types)]
                yield pa.RecordBatch.from_arrays(arrays + ([row["extra"].values] if extra else []),
                                                 fields + (["extra"] if extra else []))
    out = x.mapInArrow(run, schema)
    return out.select(*fields, *[F.col(f"extra.{c}").alias(c) for c in extra])


def _descend(layers: list[DataFrame], tops: DataFrame | None, levels: int, extra: list[str]) -> DataFrame:
    """Paths of the leaves of the lowest layer, from the top layer down.  ``tops``: (tree,
    total, subroot, path columns) of whole trees, for their last layer."""
    above = None
    for k in range(len(layers) - 1, -1, -1):
        ends = None
        if tops is not None:       # trees whose one block is in this layer
            low = FAN ** (levels * k) if k else 0
            ends = (tops.filter((F.col("total") > low) & (F.col("total") <= FAN ** (levels * (k + 1))))
                    .select("tree", F.lit(0).cast("long").alias("block"), "subroot", "siblings", "slots", "widths"))
        if above is not None:
            above = above.select("tree", F.col("idx").alias("block"), "subroot", "siblings", "slots", "widths")
            ends = above if ends is None else ends.unionByName(above)
        above = _paths(layers[k], ends, levels, extra if k == 0 else [])
    return above


def prove(manifest: Manifest, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, idx, digest, subroot, siblings, slots, widths, ...) of every leaf."""
    lowest = manifest.layers[0]
    extra = [f.name for f in lowest.schema["rows"].dataType.elementType if f.name not in ("idx", "digest")]
    forest = _descend(manifest.forest, None, levels, [])
    tops = (forest.select(F.col("idx").alias("f_tree"), F.col("digest").alias("subroot"), "siblings", "slots", "widths")
            .join(manifest.trees.select("tree", F.col("n").alias("total")), F.col("f_tree") == F.col("tree")).drop("f_tree"))
    return _descend(manifest.layers, tops, levels, extra)


def fold(digest: bytes, siblings: bytes, slots: bytes, widths: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for slot, width in zip(slots, widths):
        run = [siblings[at + _DIGEST * i:at + _DIGEST * (i + 1)] for i in range(width - 1)]
        run.insert(slot, digest)
        digest, at = parent(run), at + _DIGEST * (width - 1)
    return digest


def with_folded_root(proofs: DataFrame, of: str, out: str) -> DataFrame:
    """Adds the root recomputed from column ``of`` (a digest) and the row's proof."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema)

    def run(cols):
        args = (cols[c].to_pylist() for c in (of, "siblings", "slots", "widths"))
        return {**cols, out: [fold(*a) for a in zip(*args)]}
    return map_batches(proofs, run, f"{kinds}, `{out}` binary")
