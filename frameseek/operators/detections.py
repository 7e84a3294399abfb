"""Detection boxes (y0, x0, y1, x1) as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(a: Column) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def shared(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side(0, 2) * side(1, 3)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where there is no union."""
    union = area(a) + area(b) - shared(a, b)
    return F.when(union > 0, shared(a, b) / union).otherwise(0.0)
