"""X - text reports per key: status lines, ranked lines, framed panels, zipped panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import number_rows

# Fixed glyphs of the reference's HUD and frames.
BAR_FULL, AMMO_DOT = "█", "•"
V, H, TL, TR, BL, BR = "║", "═", "╔", "╗", "╚", "╝"


def status_line(bar_cells: int = 20, name_width: int = 10) -> Column:
    """``id: name (icon) score: s   HP: [bar] hp   AMMO: dots``; a NULL name or icon
    makes the whole line NULL, as string concatenation does in the reference."""
    hp = F.greatest(F.lit(0), F.least(F.col("hp"), F.lit(100)))
    # round(bar_cells * hp / 100) half up, in integers (hp / 5 never ends in .5)
    bar = F.greatest(F.lit(0), F.least(F.lit(bar_cells),
                                       ((F.lit(bar_cells) * hp + 50) / 100).cast("int")))
    return F.concat(
        F.col("id").cast("string"), F.lit(": "), F.rpad(F.col("name"), name_width, " "),
        F.lit(" ("), F.col("icon"), F.lit(") "),
        F.lit("score: "), F.col("score").cast("string"), F.lit("   "),
        F.lit("HP: ["), F.repeat(F.lit(BAR_FULL), bar), F.repeat(F.lit(" "), F.lit(bar_cells) - bar),
        F.lit("] "), F.greatest(F.lit(0), F.col("hp")).cast("string"), F.lit("   "),
        F.lit("AMMO: "), F.repeat(F.lit(AMMO_DOT), F.coalesce(F.col("ammo"), F.lit(0))))


def ranked_lines(lines: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """0-based line number per group in ``order``, without a single-partition window:
    numbering runs over a range partitioning of (group, order)."""
    return number_rows(lines, order, group=group, out="_rn").withColumn(
        "y", (F.col("_rn") - 1).cast("int")).drop("_rn")


def framed(rows: Column, width: int) -> Column:
    """The lines of a panel from its rows (an array): a header, each row padded (and cut) to
    ``width`` between borders, and a footer below the last row."""
    rule = F.repeat(F.lit(H), F.lit(width))
    body = F.transform(rows, lambda r: F.concat(F.lit(V), F.rpad(r, width, " "), F.lit(V)))
    return F.concat(F.array(F.concat(F.lit(TL), rule, F.lit(TR))), body, F.array(F.concat(F.lit(BL), rule, F.lit(BR))))


def panel_zip(a: Column, a_width: int, b: Column, b_width: int, side: Column, gap: str = "   ") -> Column:
    """Two framed panels (arrays of lines) and a list side by side, line by line, blanks
    where a panel has no line.  The list starts beside the first row inside the frames.
    Everything is on the key's own row, so nothing is joined or sorted by line."""
    n = F.greatest(F.size(a), F.size(b), F.size(side) + 1)

    def line(i):
        return F.concat(F.coalesce(F.get(a, i), F.repeat(F.lit(" "), F.lit(a_width + 2))), F.lit(gap),
                        F.coalesce(F.get(b, i), F.repeat(F.lit(" "), F.lit(b_width + 2))), F.lit(gap),
                        F.coalesce(F.get(side, i - 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), n - 1), line)


def lines(df: DataFrame, array: Column, key: str = "id", out: str = "line", first: int = -1) -> DataFrame:
    """(key, y, out): the lines of an array, numbered from ``first``."""
    return df.select(key, F.posexplode(array).alias("_p", out)).select(key, (F.col("_p") + first).alias("y"), out)
