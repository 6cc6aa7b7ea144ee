"""Planar geometry on coordinate arrays, as Column expressions. A ring is an array of [x, y]; a polygon an array of rings (the first outside)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_area(ring: Column) -> Column:
    """Signed shoelace area; positive for counter-clockwise rings. The ring may be closed or open."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _cross(F.get(ring, i), F.get(ring, (i + 1) % n)))
    return F.when(n < 3, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)


def _cross(p: Column, q: Column) -> Column:
    return p[0] * q[1] - q[0] * p[1]


def polygon_area(polygon: Column) -> Column:
    """Area of the outer ring without the holes."""
    holes = F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.lit(0.0), lambda a, r: a + F.abs(ring_area(r)))
    return F.abs(ring_area(polygon[0])) - holes


def km2(polygon: Column, latitude: Column) -> Column:
    """Area in km2 of a small polygon of degrees, on an equirectangular projection at the given latitude."""
    return polygon_area(polygon) * F.lit(111.32) * F.lit(110.574) * F.cos(F.radians(latitude))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring, by the parity of the edges a ray crosses."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (p[1] > y) != (q[1] > y)
        return F.when(spans & (x < (q[0] - p[0]) * F.try_divide(y - p[1], q[1] - p[1]) + p[0]), 1).otherwise(0)

    hits = F.transform(F.sequence(F.lit(0), n - 1), crosses)
    return F.aggregate(hits, F.lit(0), lambda a, v: a + v) % 2 == 1


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
