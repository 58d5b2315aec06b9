"""Three roundings that must not be mixed up, and safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """To the nearest integer, halves towards plus infinity (-2.5 gives -2)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def half_even(x: Column, scale: int = 0) -> Column:
    """Halves to the even neighbour."""
    return F.bround(x, scale)


def ratio(x: Column, y: Column, default: float = 0.0) -> Column:
    """x / y, or the default where y is 0 or null."""
    return F.when(F.coalesce(y, F.lit(0)) != 0, x / y).otherwise(F.lit(default))


def relative_change(before: Column, after: Column) -> Column:
    """|before - after| / before; null where before is 0."""
    return F.when(before != 0, F.abs(before - after) / before)


def falsy_zero(x: Column) -> Column:
    """Missing or not a number counts as 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("long")
