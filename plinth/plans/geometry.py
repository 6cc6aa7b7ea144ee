"""Queries over general polygons, made from keys of whole tables: dissolve, overlap, coverage, containment, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import overlay
from .base import Tables, query

#: Width of the grid, about that of a polygon.
CELL = 6.0


def ring(*points: tuple) -> Column:
    """A ring at (x, y) with corners at whole-number distances."""
    at = lambda c, d: (F.col(c) + d).cast("double")
    return F.array(*[F.array(at("x", dx), at("y", dy)) for dx, dy in points])


def tiles(t: Tables) -> DataFrame:
    """Two triangles for each customer: the halves of a tile on a grid of 40 columns."""
    k = F.col("c_custkey")
    c = t.customer.select(k, F.col("c_mktsegment").alias("segment"), (k % 40 * 2).alias("x"), (F.floor(k / 40) * 2).alias("y"))
    halves = F.array(F.array(ring((0, 0), (2, 0), (2, 2))), F.array(ring((0, 0), (0, 2), (2, 2))))
    return c.select("segment", F.explode(halves).alias("polygon"))


TILES = """WITH RECURSIVE t AS (SELECT c_mktsegment AS segment, c_custkey % 40 AS x, c_custkey // 40 AS y FROM customer),
r(segment, x, y, u, v) AS (SELECT segment, x, y, x, y FROM t UNION SELECT r.segment, r.x, r.y, t.x, t.y FROM r JOIN t ON t.segment = r.segment AND abs(t.x - r.u) + abs(t.y - r.v) = 1),
o AS (SELECT segment, count(*) AS outer_rings FROM (SELECT segment, x, y, min(v * 40 + u) AS first FROM r GROUP BY ALL) WHERE first = y * 40 + x GROUP BY segment),
c AS (SELECT segment, x + dx AS x, y + dy AS y, count(*) AS n, sum(CASE WHEN dx = dy THEN 1 ELSE 0 END) AS same FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dx, dy) GROUP BY ALL),
e AS (SELECT segment, sum(CASE WHEN n = 1 THEN 1 WHEN n = 2 AND same <> 1 THEN 2 WHEN n = 3 THEN -1 ELSE 0 END) / 4 AS turns FROM c GROUP BY segment),
a AS (SELECT segment, 4.0 * count(*) AS area FROM t GROUP BY segment)"""


@query("q_dissolve", f"{TILES} SELECT segment, outer_rings::BIGINT AS outer_rings, (outer_rings - turns)::BIGINT AS holes, area::DOUBLE AS area FROM o JOIN e USING (segment) JOIN a USING (segment)")
def dissolve(t: Tables):
    """Segments as the areas that their customers' tiles make up together: outer rings, holes and area."""
    count = lambda cond: F.count_if(F.expr(cond))
    return overlay.dissolve(tiles(t), "segment").groupBy("segment").agg(count("area > 0").alias("outer_rings"), count("area < 0").alias("holes"), F.sum("area").alias("area"))


def crowns(t: Tables) -> DataFrame:
    """Concave polygons of customers: a square with a notch from above."""
    k = F.col("c_custkey")
    c = t.customer.select(k, "c_nationkey", (k * 5 % 1196).alias("x"), (F.floor(k / 400) * 3).alias("y"))
    return c.select("*", F.array(ring((0, 0), (4, 0), (4, 4), (2, 2), (0, 4))).alias("polygon"))


def diamonds(t: Tables) -> DataFrame:
    """Diamonds of suppliers with a square hole, the ring of the hole in the direction of the other."""
    k = F.col("s_suppkey")
    c = t.supplier.select(k, (k % 100 * 12 + 6).alias("x"), (F.floor(k / 100) * 12 + 6).alias("y"), (3 + k % 4).alias("r"), (1 + k % 2).alias("h"))
    at = lambda c, s, d: (F.col(c) + F.lit(s) * F.col(d)).cast("double")
    of = lambda d, *p: F.array(*[F.array(at("x", dx, d), at("y", dy, d)) for dx, dy in p])
    return c.select(k, F.array(of("r", (1, 0), (0, 1), (-1, 0), (0, -1)), of("h", (1, 1), (-1, 1), (-1, -1), (1, -1))).alias("polygon"))


#: The same polygons as sets of quarters of unit squares (each square is cut by its diagonals): x, y, and which quarter, with its middle at (mx, my).
QUARTERS = """q AS (SELECT * FROM (VALUES (0, 0.5, 1 / 6), (1, 0.5, 5 / 6), (2, 1 / 6, 0.5), (3, 5 / 6, 0.5)) v(quarter, mx, my)),
c AS (SELECT c_custkey, c_nationkey, (c_custkey * 5) % 1196 + i AS x, (c_custkey // 400) * 3 + j AS y, quarter FROM customer, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j), q WHERE j + my < abs(i + mx - 2) + 2),
s AS (SELECT s_suppkey, (s_suppkey % 100) * 12 + 6 + i AS x, (s_suppkey // 100) * 12 + 6 + j AS y, quarter FROM supplier, (SELECT unnest(range(-6, 6)) AS i), (SELECT unnest(range(-6, 6)) AS j), q
  WHERE abs(i + mx) + abs(j + my) < 3 + s_suppkey % 4 AND greatest(abs(i + mx), abs(j + my)) > 1 + s_suppkey % 2),
sa AS (SELECT s_suppkey, count(*) / 4 AS area FROM s GROUP BY s_suppkey),
o AS (SELECT c_custkey, s_suppkey, count(*) / 4 AS overlap FROM c JOIN s USING (x, y, quarter) GROUP BY ALL)"""


@query(
    "q_polygon_jaccard",
    f"WITH {QUARTERS} SELECT c_custkey, s_suppkey, overlap, 12 - overlap AS a_outside, area - overlap AS b_outside, round(overlap / (12 + area - overlap), 9) AS jaccard, overlap = 12 AS nested FROM o JOIN sa USING (s_suppkey)",
)
def polygon_jaccard(t: Tables):
    return overlay.compared(crowns(t), diamonds(t), "c_custkey", "s_suppkey", CELL).withColumn("jaccard", F.round("jaccard", 9))


#: The supplier in whose square of the plane a customer's corner lies; customers of some nations are entered under its neighbour.
ASSIGNED = "CAST(floor(floor(c_custkey / 400) * 3 / 12) * 100 + floor((c_custkey * 5) % 1196 / 12) + CASE WHEN c_nationkey % 5 = 4 THEN 1 ELSE 0 END AS BIGINT)"


@query(
    "q_union_coverage",
    f"""WITH {QUARTERS}, a AS (SELECT DISTINCT s_suppkey, x, y, quarter, c_custkey FROM (SELECT *, {ASSIGNED} AS s_suppkey FROM c) JOIN sa USING (s_suppkey)),
    u AS (SELECT s_suppkey, x, y, quarter, count(*) AS n FROM a GROUP BY ALL),
    m AS (SELECT s_suppkey, count(*) / 4 AS union_area, count(s.x) / 4 AS covered, (count(*) - count(s.x)) / 4 AS spilt, count(CASE WHEN n > 1 THEN 1 END) / 4 AS doubled FROM u LEFT JOIN s USING (s_suppkey, x, y, quarter) GROUP BY s_suppkey)
    SELECT s_suppkey, union_area, covered, spilt, doubled, area - covered AS gap, round(covered / area, 9) AS coverage, round(spilt / union_area, 9) AS spill FROM m JOIN sa USING (s_suppkey)""",
)
def union_coverage(t: Tables):
    children = crowns(t).withColumn("s_suppkey", F.expr(ASSIGNED))
    m = overlay.union_coverage(diamonds(t), children, "s_suppkey", CELL)
    return m.withColumns({"coverage": F.round("coverage", 9), "spill": F.round("spill", 9)})


#: The shares of a child that its parent should hold.
BANDS, STRAY = [0.99, 0.9, 0.5, 0.1], 0.1


@query(
    "q_containment_bands",
    f"""WITH {QUARTERS}, w AS (SELECT c_custkey, {ASSIGNED} AS s_suppkey FROM customer),
    most AS (SELECT c_custkey, arg_max(s_suppkey, overlap * 1000000 - s_suppkey) AS held_by FROM o GROUP BY c_custkey),
    f AS (SELECT w.c_custkey, w.s_suppkey, coalesce(overlap, 0) / 12 AS share, held_by FROM w LEFT JOIN o USING (c_custkey, s_suppkey) LEFT JOIN most ON most.c_custkey = w.c_custkey)
    SELECT c_custkey, s_suppkey, round(share, 9) AS share, (CASE WHEN share >= 0.99 THEN 0.99 WHEN share >= 0.9 THEN 0.9 WHEN share >= 0.5 THEN 0.5 WHEN share >= 0.1 THEN 0.1 ELSE 0 END)::DOUBLE AS band, CASE WHEN share < 0.1 THEN held_by END AS actual FROM f""",
)
def containment_bands(t: Tables):
    children = crowns(t).withColumn("s_suppkey", F.expr(ASSIGNED))
    return overlay.contained(children, diamonds(t), "c_custkey", "s_suppkey", CELL, BANDS, STRAY).withColumn("share", F.round("share", 9))


@query(
    "q_polygon_repair",
    """WITH p AS (SELECT c_custkey, c_custkey % 4 AS kind, (2 + c_nationkey % 5)::DOUBLE AS s FROM customer),
    m AS (SELECT c_custkey, CASE kind WHEN 1 THEN 0 WHEN 3 THEN 2 * s * s ELSE s * s END AS before, CASE kind WHEN 1 THEN s * s / 2 WHEN 3 THEN 2 * s * s - 2 ELSE s * s END AS after, CASE kind WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS crossings, CASE kind WHEN 2 THEN 1 ELSE 0 END AS doubled_edges FROM p)
    SELECT c_custkey, before::DOUBLE AS before, after::DOUBLE AS after, round(abs(after - before) / greatest(after, before), 9) AS delta, crossings::BIGINT AS crossings, doubled_edges::BIGINT AS doubled_edges, before <> after OR crossings > 0 OR doubled_edges > 0 AS defective FROM m""",
)
def polygon_repair(t: Tables):
    """A sound square, a bow-tie, a square with a spike that is run along twice, and a ring that goes round two squares, which share a unit square."""
    k, s = F.col("c_custkey"), F.col("s")
    c = t.customer.select(k, (2 + F.col("c_nationkey") % 5).alias("s"), (k % 100 * 20).alias("x"), (F.floor(k / 100) * 20).alias("y"))
    at = lambda *p: F.array(*[F.array((F.col("x") + dx).cast("double"), (F.col("y") + dy).cast("double")) for dx, dy in p])
    square, bow = at((0, 0), (s, 0), (s, s), (0, s)), at((0, 0), (s, s), (s, 0), (0, s))
    spike = at((0, 0), (s, 0), (s + 2, 0), (s, 0), (s, s), (0, s))
    double = at((s, s - 1), (s, s), (0, s), (0, 0), (s, 0), (s, s - 1), (2 * s - 1, s - 1), (2 * s - 1, 2 * s - 1), (s - 1, 2 * s - 1), (s - 1, s - 1))
    shape = F.when(k % 4 == 0, square).when(k % 4 == 1, bow).when(k % 4 == 2, spike).otherwise(double)
    return overlay.repaired(c.select(k, F.array(shape).alias("polygon")), "c_custkey", CELL).withColumn("delta", F.round("delta", 9))


@query("q_area_holes", "SELECT s_suppkey, round((2 * r * r - 4 * h * h) / 100 * 111.32 * 110.574 * cos(radians(y / 10)), 3) AS km2 FROM (SELECT s_suppkey, 3 + s_suppkey % 4 AS r, 1 + s_suppkey % 2 AS h, (s_suppkey // 100) * 12 + 6 AS y FROM supplier)")
def area_holes(t: Tables):
    """Areas in km2 of polygons of degrees with a hole, at the latitude of their middle."""
    degrees = F.transform("polygon", lambda r: F.transform(r, lambda p: F.transform(p, lambda v: v / 10)))
    middle = (F.floor(F.col("s_suppkey") / 100) * 12 + 6) / 10
    return diamonds(t).select("s_suppkey", F.round(geo.km2(degrees, middle), 3).alias("km2"))
