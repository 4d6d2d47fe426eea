"""R - grid and raster construction.

A grid is a long DataFrame ``(x LONG, y LONG, tile STRING)``, one row per cell.
Rectangles are ``(x1, y1, x2, y2)`` inclusive integer corners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.joins import by_hash, by_merge
from tessera.functions.num import explode_range, idiv
from tessera.functions.ranking import add_prefix_sums, with_bucket

# Fixed tile values of the reference's map.
WALL, FLOOR, RESPAWN = "#", ".", "R"


def lattice(spark: SparkSession, x0: int, x1: int, y0: int, y1: int,
            num_partitions: int | None = None) -> DataFrame:
    """Dense grid of inclusive bounds as one distributed range (no cross join)."""
    w, h = x1 - x0 + 1, y1 - y0 + 1
    if w <= 0 or h <= 0:
        return spark.range(0).select(F.col("id").alias("x"), F.col("id").alias("y"))
    ids = spark.range(0, w * h, numPartitions=num_partitions)
    return ids.select((F.lit(x0) + F.col("id") % w).alias("x"), (F.lit(y0) + idiv("id", w)).alias("y"))


def band_lattice(rows: DataFrame, width: int) -> DataFrame:
    """Every cell (x, y) of the given rows (y)."""
    return rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"), "y")


def normalize_rects(rects: DataFrame, x1="x1", y1="y1", x2="x2", y2="y2") -> DataFrame:
    """Order reversed corners: (least, least, greatest, greatest)."""
    return rects.withColumns({
        x1: F.least(F.col(x1), F.col(x2)), y1: F.least(F.col(y1), F.col(y2)),
        x2: F.greatest(F.col(x1), F.col(x2)), y2: F.greatest(F.col(y1), F.col(y2)),
    })


def filter_rects(rects: DataFrame, min_w: int = 6, min_h: int = 6) -> DataFrame:
    """Rectangles whose inclusive width and height reach the minimum."""
    return rects.filter((F.col("x2") - F.col("x1") + 1 >= min_w)
                        & (F.col("y2") - F.col("y1") + 1 >= min_h))


def rect_centroids(rects: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """floor((x1+x2)/2.0), floor((y1+y2)/2.0) as INT."""
    return rects.select(*keep,
                        F.floor((F.col("x1") + F.col("x2")) / 2.0).cast("long").alias("x"),
                        F.floor((F.col("y1") + F.col("y2")) / 2.0).cast("long").alias("y"))


def rasterize_rects(rects: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every inclusive cell of every rectangle; overlaps give duplicate cells.
    A reversed rectangle yields nothing (call ``normalize_rects`` first)."""
    return (rects
            .select(*keep, "y1", "y2", explode_range("x1", "x2").alias("x"))
            .select(*keep, "x", explode_range("y1", "y2").alias("y")))


def overlap_runs(rects: DataFrame, weight: str | None = None, bucket: int = 4096) -> DataFrame:
    """(y, x1, x2, n): the runs of cells of a row that ``n`` rectangles cover, n other than 0.

    A rectangle costs two signed events per row, where it begins and behind its end, and not
    its area; equal places are added up before the exchange, and the running sum of a row
    is split by pieces of ``bucket`` columns, so one row may hold a third of all events.
    Rectangles are dealt over the shuffle partitions before they become events, so that no
    task adds up more than its share, however few tasks read the table.
    ``weight`` (1 by default) is what a rectangle counts: -1 takes away one that was counted
    before.  Reversed rectangles, and those with a NULL corner or weight, cover nothing."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    tasks = int(rects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rects.filter("x1 <= x2").select("x1", "x2", "y1", "y2", w.alias("w")).repartition(tasks)
    rows = rows.select(F.col("x1").cast("long"), F.col("x2").cast("long"), "w", explode_range("y1", "y2").alias("y"))
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("w").alias("d")), F.struct((F.col("x2") + 1).alias("x"), (-F.col("w")).alias("d")))
    events = (rows.select(F.col("y").cast("long").alias("y"), F.inline(ends)).groupBy("y", "x").agg(F.sum("d").alias("d")).filter("d <> 0"))
    e = add_prefix_sums(with_bucket(events, "y", F.floor(F.col("x") / bucket)), ["x"], {"n": F.col("d")})
    # a run ends before the next event of its row, which may lie in a later piece
    e = e.withColumn("_next", F.lead("x").over(Window.partitionBy("_k", "_b").orderBy("x")))
    later = Window.partitionBy("_k2").orderBy("_b2")
    pieces = (events.groupBy(F.struct("y").alias("_k2"), F.floor(F.col("x") / bucket).alias("_b2")).agg(F.min("x").alias("_first"))
              .withColumn("_after", F.lead("_first").over(later)))
    j = e.join(by_merge(pieces), (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2")))
    return j.filter("n <> 0").select("y", F.col("x").alias("x1"), (F.coalesce("_next", "_after") - 1).alias("x2"), "n")


def overlap_counts(rects: DataFrame, weight: str | None = None) -> DataFrame:
    """(x, y, n): how many rectangles cover each cell that any covers."""
    return overlap_runs(rects, weight).select(explode_range("x1", "x2").alias("x"), "y", "n")


def classify_cells(cells: DataFrame, layers: list[tuple[DataFrame, str]],
                   default: str = WALL) -> DataFrame:
    """Priority overlay on a lattice: ``layers`` is highest priority first, each a
    DataFrame of (x, y); a cell takes the tile of the first layer that contains it,
    else ``default``.  One row per lattice cell.

    All layers are unioned with a priority and reduced to one row per cell by a
    partial+final aggregate before the single join to the lattice, so duplicate
    cells never fan the lattice out.
    """
    n = len(layers)
    marked = None
    for i, (layer, _tile) in enumerate(layers):
        part = layer.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"),
                            F.lit(n - i).alias("prio"))
        marked = part if marked is None else marked.unionByName(part)
    # max(prio) is a fixed-width hash aggregate; the winning priority maps back to
    # its tile by a CASE (max_by over a string would need a sort-based aggregate)
    best = marked.groupBy("x", "y").agg(F.max("prio").alias("prio"))
    tile = None
    for i, (_layer, t) in enumerate(layers):
        hit = F.col("prio") == n - i
        tile = F.when(hit, F.lit(t)) if tile is None else tile.when(hit, F.lit(t))
    tile = F.lit(default) if tile is None else tile.otherwise(F.lit(default))
    return cells.join(best, ["x", "y"], "left").select("x", "y", tile.alias("tile"))


def grid_extent(grid: DataFrame) -> DataFrame:
    return grid.agg(F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def glyph_cells(stamps: DataFrame, id_col: str, lines_col: str,
                transparent: str = ".") -> DataFrame:
    """Text art -> (id, sx, sy, ch): one row per character of each line,
    ``transparent`` characters become NULL."""
    rows = stamps.select(F.col(id_col).alias("stamp_id"),
                         F.posexplode(lines_col).alias("sy", "line"))
    chars = rows.select("stamp_id", "sy",
                        F.posexplode(F.split(F.col("line"), "")).alias("sx", "ch"))
    return chars.select("stamp_id", F.col("sx").cast("int").alias("sx"),
                        F.col("sy").cast("int").alias("sy"),
                        F.nullif(F.col("ch"), F.lit(transparent)).alias("ch"))



class PackedGrid:
    """A grid of given rows, each ``width`` cells wide, packed as 64-cell words: one
    row per (y, word) with one bit mask per priority layer.  A cell set in no layer
    holds the default tile; cells of other rows, or beyond the width, do not exist.

    Built by ``bit_or`` aggregates over the covered cells only (no lattice, no
    lambdas), so the whole grid costs rows x ceil(width/64) small rows.  A point
    finds its tile by an equi-join on (row, word) and a bit test.  The packed side grows with
    the world and is merged with, never broadcast (``joins.by_merge``); for points that
    outnumber the words it is hashed (``joins.by_hash``)."""

    WORD = 64

    def __init__(self, masks: DataFrame, tiles: list[str], default: str, width: int, max_y: Column):
        self.masks, self.tiles, self.default = masks, tiles, default
        self.width, self.max_y = width, max_y

    @classmethod
    def from_layers(cls, layers: list[tuple[DataFrame, str]], width: int, rows: DataFrame,
                    default: str = WALL, max_y: Column | None = None) -> "PackedGrid":
        """A layer is (x, y) cells or (x1, x2, y) runs of cells; ``rows``: (y) of the rows that
        exist; ``max_y``: the last of them, if it is known as a scalar."""
        words = F.sequence(F.lit(0).cast("long"), F.lit((width - 1) // cls.WORD).cast("long"))
        marked = rows.select("y", F.explode(words).alias("w"), F.lit(-1).alias("li"), F.lit(0).cast("long").alias("bit"))
        for i, (layer, _tile) in enumerate(layers):
            if "x" in layer.columns:
                layer = layer.selectExpr("x AS x1", "x AS x2", "y")
            # one row per run and word it touches: bits x1 to x2, cut to the word
            part = (layer.selectExpr("CAST(y AS BIGINT) AS y", "greatest(CAST(x1 AS BIGINT), 0L) AS x1",
                                     f"least(CAST(x2 AS BIGINT), {width - 1}L) AS x2").filter("x1 <= x2")
                    .selectExpr("y", "x1", "x2", f"explode(sequence(x1 DIV {cls.WORD}, x2 DIV {cls.WORD})) AS w")
                    .selectExpr("y", "w", f"{i} AS li", f"shiftleft(-1L, CAST(greatest(x1 - w * {cls.WORD}, 0) AS INT)) & "
                                f"shiftrightunsigned(-1L, CAST({cls.WORD - 1} - least(x2 - w * {cls.WORD}, {cls.WORD - 1}) AS INT)) AS bit"))
            marked = marked.unionByName(part)
        masks = (marked.groupBy("y", "w")
                 .agg(F.min("li").alias("li"),
                      *[F.coalesce(F.bit_or(F.when(F.col("li") == i, F.col("bit"))), F.lit(0)).alias(f"m{i}")
                        for i in range(len(layers))])
                 .filter("li = -1").drop("li"))
        if max_y is None:
            max_y = rows.agg(F.max("y")).scalar()
        return cls(masks, [t for _, t in layers], default, width, max_y)

    def _tile(self, bit: Column, mask) -> Column:
        """The tile at place ``bit`` of the words ``mask(i)``."""
        tile = None
        for i, t in enumerate(self.tiles):
            hit = F.call_function("shiftrightunsigned", mask(i), bit.cast("int")).bitwiseAND(F.lit(1)) == 1
            tile = F.when(hit, F.lit(t)) if tile is None else tile.when(hit, F.lit(t))
        return F.lit(self.default) if tile is None else tile.otherwise(F.lit(self.default))

    def cells(self) -> DataFrame:
        """(x, y, tile) of every cell."""
        out = self.masks.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(self.WORD - 1))))
        out = out.withColumn("x", F.col("w") * self.WORD + F.col("_i")).filter(F.col("x") < self.width)
        return out.select("x", "y", self._tile(F.col("_i"), lambda i: F.col(f"m{i}")).alias("tile"))

    def lookup(self, points: DataFrame, x: str = "cx", y: str = "cy", out: str = "tile", streamed: bool = False) -> DataFrame:
        """``streamed``: the points are many; they pass by unsorted."""
        side = self.masks.select(F.col("y").alias("_gy"), F.col("w").alias("_gw"),
                                 *[F.col(f"m{i}").alias(f"_m{i}") for i in range(len(self.tiles))])
        px, py = F.col(x).cast("long"), F.col(y).cast("long")
        j = points.withColumn("_pw", F.floor(px / self.WORD)).join(
            (by_hash if streamed else by_merge)(side), (py == F.col("_gy")) & (F.col("_pw") == F.col("_gw")), "left")
        tile = self._tile(F.pmod(px, F.lit(self.WORD)), lambda i: F.col(f"_m{i}"))
        inside = F.col("_gy").isNotNull() & (px >= 0) & (px < self.width)
        return (j.withColumn(out, F.when(inside, tile))
                .drop("_pw", "_gy", "_gw", *[f"_m{i}" for i in range(len(self.tiles))]))
