"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of one batch, reduced to (node, smallest node of its part): at most
    one link per node and the same connectivity."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, lab, new)      # a root follows its lowest member
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    own = lab != np.arange(len(nodes))
    return nodes[own], nodes[lab[own]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step.  The minimum of a node's neighbours is a partial aggregate joined back,
    and cut before that, so the join's shuffle is its own and Spark can split a hub."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = cut(both.groupBy("u").agg(F.min("v").alias("m"))
              .select("u", F.least("u", "m").alias("m")))
    near = both.join(low, "u")
    if large:
        out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (near.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(low.select("u", F.col("m").alias("v"))))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root) for every node that has a link to a smaller one;
    root is the smallest node of the component.  Rounds grow with the logarithm of the
    number of nodes; each is checkpointed to the shared folder."""
    cur = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .filter(F.col("u") != F.col("v")).distinct())
    seen = None
    while True:
        mark = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        cur = cut(_star(_star(cur, True), False))
