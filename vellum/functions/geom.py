"""Boxes as arrays of four doubles (x0, y0, x1, y1): native geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[c.cast("double") for c in (x0, y0, x1, y1)])


def valid_box(c: Column) -> Column:
    """Four numbers, or null."""
    return F.when((F.size(c) == 4) & F.forall(c, lambda x: x.isNotNull()), c)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; the union counts as 1 at least."""
    both = intersection(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1.0))


def x_overlap(a: Column, b: Column) -> Column:
    """Shared width as a share of the narrower box."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return w / F.greatest(F.least(a[2] - a[0], b[2] - b[0]), F.lit(1.0))


def y_gap(a: Column, b: Column) -> Column:
    """Vertical distance, 0 if they overlap."""
    return F.greatest(F.lit(0.0), F.greatest(a[1], b[1]) - F.least(a[3], b[3]))


def x_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a[0], b[0]) - F.least(a[2], b[2]))


def relation(a: Column, b: Column, near: float = 60.0) -> Column:
    """The first that holds: contains, above, below, left_of, right_of, overlaps, near; else null.

    near holds if the gap along either axis is under the limit, so far boxes in one band count.
    """
    return (
        F.when((a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3]), "contains")
        .when(a[3] <= b[1], "above")
        .when(a[1] >= b[3], "below")
        .when(a[2] <= b[0], "left_of")
        .when(a[0] >= b[2], "right_of")
        .when(intersection(a, b) > 0, "overlaps")
        .when((x_gap(a, b) < near) | (y_gap(a, b) < near), "near")
    )
