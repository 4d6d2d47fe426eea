"""Column expressions on the lines of a text (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import WS_CHARS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), _UPPER, _LOWER)


def without(text: Column, drops: Column, key) -> Column:
    """The lines of ``text`` whose key is not in the array ``drops``, joined by newline;
    the text itself where there is nothing to drop."""
    kept = F.filter(split_lines(text), lambda line: ~F.array_contains(drops, key(line)))
    return F.when(drops.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once (inside lambdas an outer expression would
    be computed again for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)
