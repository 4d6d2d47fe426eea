"""Numeric column helpers shared by all operators.

* ``cell``       - double -> int the way the reference dialect casts: round half to
  even (Spark's plain cast truncates), so a cell is centred on its integer coordinate.
* ``floor_cell`` - double -> int by floor (the minimap's binning).
* ``idiv``       - integer division truncating toward zero (reference ``int / int``).
* ``q6``         - quantise a double to 1e-6 with floor(v*1e6+0.5)/1e6, so results are
  stable across engines whose trig differs in the last ulp.
* ``safe_seq``   - inclusive integer series that is empty when lo > hi
  (Spark ``sequence(3, 1)`` would count down instead).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def cell(c) -> Column:
    """Grid coordinates are LONG: the world grows with the largest key of a table."""
    return F.rint(col(c)).cast("long")


def floor_cell(c) -> Column:
    return F.floor(col(c)).cast("long")


def idiv(a, b) -> Column:
    a, b = col(a).cast("long"), col(b).cast("long")
    return ((a - a % b) / b).cast("long")


def q6(c) -> Column:
    return F.floor(col(c) * 1e6 + 0.5) / 1e6


def safe_seq(lo, hi) -> Column:
    lo, hi = col(lo), col(hi)
    return F.when(lo <= hi, F.sequence(lo, hi))


def explode_range(lo, hi) -> Column:
    """Rows lo..hi inclusive; no rows when lo > hi (a NULL array explodes to nothing)."""
    return F.explode(safe_seq(lo, hi))


def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ read as a UTC wall clock,
    independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col(c))
