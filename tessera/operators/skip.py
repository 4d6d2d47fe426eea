"""L - first hits by skipping empty space.

Around every observer, the chessboard distance of each cell to the next wall is a field of
bits: the walls of the packed square, then the cells within one of a wall, within two, and so
on, each plane from the one before by shifts and ORs of whole words (a word is up to 31
cells, and all observers of a batch are shifted at once).  The planes are nested, so three
words hold the distance in binary, 0 to 7.

A ray looks at the field where it stands.  Distance 0 is the hit; at distance d no wall can
be entered before the ray leaves the square of d - 1 cells around its cell, so it jumps to
the last sample in there, or on by one.  What it samples is what the plain march samples at
that step, so the hits are the same.

A ray is one row, of which the jumps are iterations over arrays; the one exchange is the one
by observer that gathers the packed square (``sight.neighbourhood``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators import sight
from tessera.operators.raster import PackedGrid
from tessera.params import ViewParams

FAR = 7                       # distances beyond count as 7: what three bits hold
_CELLS, _ONES = sight._CELLS, np.uint64(0x1555555555555555)       # a bit of each of 31 cells


def _widened(p: np.ndarray) -> np.ndarray:
    """Planes (observer, row, word) with every set cell's eight neighbours set."""
    two, top = np.uint64(2), np.uint64(2 * (_CELLS - 1))
    flat = p | (p << two) & _ONES | p >> two
    if p.shape[2] > 1:
        flat[:, :, 1:] |= p[:, :, :-1] >> top & np.uint64(1)
        flat[:, :, :-1] |= (p[:, :, 1:] & np.uint64(1)) << top
    out = flat.copy()
    out[:, 1:] |= flat[:, :-1]
    out[:, :-1] |= flat[:, 1:]
    return out


def distance_field(near: np.ndarray) -> np.ndarray:
    """(3, observer, row, word) from the cell codes (observer, row, word): the distance to the
    next blocked cell in binary, at the cell's even bit of its word."""
    one = np.uint64(1)
    planes = [near & _ONES & ~(near >> one)]                  # code 1: blocked
    for _ in range(FAR - 1):
        planes.append(_widened(planes[-1]))
    out = np.zeros((3, *near.shape), np.uint64)
    for d in range(1, FAR + 1):                     # outside plane d - 1 and inside plane d
        here = ~planes[d - 1] & _ONES
        if d < FAR:
            here &= planes[d]
        for k in range(3):
            if d >> k & 1:
                out[k] |= here
    return out


def first_hits(x: np.ndarray, y: np.ndarray, facing: np.ndarray, x0: np.ndarray, y0: np.ndarray, near: np.ndarray,
               vp: ViewParams) -> tuple[np.ndarray, ...]:
    """(observer, column, n, distance of the hit) of the rays with a hit, and how often the field
    was looked at in all."""
    field = distance_field(near)
    cols = np.arange(vp.view_w + 1 if vp.inclusive_edge else vp.view_w)
    angle = facing[:, None] - vp.fov / 2.0 + vp.fov * (cols.astype(float) / (vp.view_w - 1))
    dx, dy = vp.step * np.cos(angle), vp.step * np.sin(angle)
    who, col = (a.ravel() for a in np.indices(angle.shape))
    dx, dy, n = dx.ravel(), dy.ravel(), np.ones(angle.size, np.int64)
    hit = np.zeros(angle.size, np.int64)
    rays, probes = np.arange(angle.size), 0
    while len(rays):
        probes += len(rays)
        o, at = who[rays], n[rays]
        px, py = x[o] + at * dx[rays], y[o] + at * dy[rays]
        cx, cy = np.rint(px), np.rint(py)
        i, j = (cx - x0[o]).astype(np.int64), (cy - y0[o]).astype(np.int64)
        word, bit = i // _CELLS, (2 * (i % _CELLS)).astype(np.uint64)
        d = sum(((field[k, o, j, word] >> bit & np.uint64(1)) << np.uint64(k)) for k in range(3)).astype(np.int64)
        wall = d == 0
        hit[rays[wall]] = at[wall]
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = [np.where(v == 0, np.inf, (d - 0.5 + np.sign(v) * (c - p)) / np.abs(v)) for v, c, p in ((dx[rays], cx, px), (dy[rays], cy, py))]
        jump = np.floor(np.minimum(np.minimum(*reach), vp.max_steps) - 1e-6).astype(np.int64)
        n[rays] = at + np.maximum(jump, 1)
        rays = rays[~wall & (n[rays] <= vp.max_steps)]
    found = np.flatnonzero(hit)
    dist = (hit[found] - 1) * vp.step * np.cos(angle.ravel()[found] - facing[who[found]])
    return who[found], col[found], hit[found], dist, probes


def skip_hits(observers: DataFrame, grid: PackedGrid, vp: ViewParams = ViewParams()) -> DataFrame:
    """(id, col, n, dist) as ``sight.first_hit``, and ``probes``: how often the rays of the
    observer's batch looked at the field, on the first row of a batch (0 on the others).

    Observers with a NULL place or direction see nothing; rays without a hit are absent."""
    assert vp.fov < 3.141592653589793
    near = sight.neighbourhood(observers.filter("x IS NOT NULL AND y IS NOT NULL AND dir IS NOT NULL"), grid, vp)
    rows, words = 2 * vp.reach + 1, sight.longs_per_row(vp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                x, y, facing, x0, y0 = (b.column(c).to_numpy() for c in ("x", "y", "dir", "_x0", "_y0"))
                packed = b.column("_near").flatten().to_numpy().view(np.uint64).reshape(-1, rows, words)
                who, col, n, dist, probes = first_hits(x, y, facing, x0, y0, packed, vp)
                count = np.zeros(len(who), np.int64)
                count[:1] = probes
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(who)), pa.array(col.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(dist),
                     pa.array(count)], ["id", "col", "n", "dist", "probes"])
    kind = near.schema["id"].dataType.simpleString()
    src = near.select("id", "x", "y", "dir", "_x0", "_y0", "_near")
    return src.mapInArrow(run, f"id {kind}, col int, n int, dist double, probes long")
