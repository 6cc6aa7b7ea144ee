"""General polygons: overlap, coverage, repair and dissolve against figures worked out by hand and a fine grid of points."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import overlay

SCHEMA = "id long, polygon array<array<array<double>>>"
SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]


def test_overlap_of_a_hole_and_a_closed_clockwise_ring(spark):
    a = spark.createDataFrame([(1, [SQUARE, HOLE])], SCHEMA)
    b = spark.createDataFrame([(7, [[[0.5, 0.5], [0.5, 3.0], [3.0, 3.0], [3.0, 0.5], [0.5, 0.5]]]), (8, [[[9.0, 9.0], [9.5, 9.0], [9.0, 9.5]]])], SCHEMA.replace("id", "other"))
    for width in (0.75, 2.0, 50.0):
        r = overlay.compared(a, b, "id", "other", width).collect()
        assert [(x.id, x.other, x.nested) for x in r] == [(1, 7, False)]
        assert r[0].overlap == pytest.approx(2.5 * 2.5 - 1) and r[0].a_outside == pytest.approx(15 - 5.25) and r[0].b_outside == pytest.approx(1.0)


def inside(polygon, x, y):
    found = False
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                found = not found
    return found


def star(rng, n=9):
    import math

    x, y = rng.uniform(2, 8), rng.uniform(2, 8)
    return [[[x + (r := rng.uniform(0.5, 3)) * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)] for i in range(n)]]


def test_random_stars_agree_with_a_grid_of_points(spark):
    rng = random.Random(3)
    a, b = [(i, star(rng)) for i in range(5)], [(i, star(rng)) for i in range(5)]
    got = {(r.id, r.other): r.overlap for r in overlay.overlaps(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA.replace("id", "other")), "id", "other", 1.5).collect()}
    step, points = 0.05, [(i * 0.05 + 0.02, j * 0.05 + 0.02) for i in range(-30, 260) for j in range(-30, 260)]
    held = {("a", i): {p for p in points if inside(s, *p)} for i, s in a} | {("b", i): {p for p in points if inside(s, *p)} for i, s in b}
    for i, _ in a:
        for j, _ in b:
            assert got.get((i, j), 0.0) == pytest.approx(len(held["a", i] & held["b", j]) * step * step, abs=0.15)
    # the union of all of b over each of a, by strips
    parents = spark.createDataFrame(a, SCHEMA)
    children = parents.select("id").crossJoin(spark.createDataFrame(b, SCHEMA).select("polygon"))
    all_b = set().union(*(held["b", j] for j, _ in b))
    for r in overlay.union_coverage(parents, children, "id", 1.5).collect():
        assert r.union_area == pytest.approx(len(all_b) * step * step, abs=0.4)
        assert r.covered == pytest.approx(len(all_b & held["a", r.id]) * step * step, abs=0.3)
        assert r.covered + r.gap == pytest.approx(overlay.areas(parents, "id").filter(F.col("id") == r.id).first().area)


def test_repair_of_a_pentagram(spark):
    import math

    points = [[math.cos(4 * math.pi * i / 5), math.sin(4 * math.pi * i / 5)] for i in range(5)]
    r = overlay.repaired(spark.createDataFrame([(1, [points]), (2, [SQUARE, HOLE[::-1]])], SCHEMA), "id", 0.4).collect()
    r = {x.id: x for x in r}
    assert r[1].crossings == 5 and r[1].defective and not r[2].defective and r[2].after == pytest.approx(15.0)
    core = 5 / 2 * math.sin(2 * math.pi / 5) * ((3 - math.sqrt(5)) / 2) ** 2
    assert r[1].before - r[1].after == pytest.approx(2 * core)


def test_dissolve_of_neighbours_with_different_corners(spark):
    """A wide box under two narrow ones, and a far one that touches a corner only."""
    box = lambda x0, y0, x1, y1: [[[float(x0), float(y0)], [float(x1), float(y0)], [float(x1), float(y1)], [float(x0), float(y1)]]]
    rows = [(1, box(0, 0, 4, 1)), (1, box(0, 1, 2, 2)), (1, box(2, 1, 4, 2)), (1, box(4, 2, 5, 3)), (2, [SQUARE, HOLE]), (2, box(1, 1, 2, 2))]
    got = overlay.dissolve(spark.createDataFrame(rows, SCHEMA), "id", cell=1.5).collect()
    assert sorted((r.id, r.area) for r in got) == [(1, 1.0), (1, 8.0), (2, 16.0)]
    whole = next(r for r in got if r.area == 8.0)
    assert sorted(map(tuple, whole.ring)) == [(0, 0), (0, 1), (0, 2), (2, 2), (4, 0), (4, 1), (4, 2)]
    assert all(a != b for a, b in zip(whole.ring, whole.ring[1:]))


def test_long_rings_are_linked_in_order(spark):
    n = 300
    ring = [[float(i), 0.0] for i in range(n)] + [[float(n - 1 - i), 1.0] for i in range(n)]
    r = overlay.dissolve(spark.createDataFrame([(5, [ring]), (5, [[[900.0, 0.0], [901.0, 0.0], [900.0, 1.0]]])], SCHEMA), "id").collect()
    long = next(x.ring for x in r if len(x.ring) > 3)
    at = long.index([0.0, 0.0])
    assert long[at:] + long[:at] == ring and sorted(x.area for x in r) == [0.5, n - 1.0]


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert overlay.dissolve(none, "id").count() == 0 and overlay.repaired(none, "id", 1.0).count() == 0
    assert overlay.overlaps(none, none.withColumnRenamed("id", "other"), "id", "other", 1.0).count() == 0
