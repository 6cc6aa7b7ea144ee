"""General polygons, concave and with holes, as rows of edges: overlap, union, coverage, repair and dissolve.

A polygon is an array of rings of [x, y] (the first outside, open or closed, in either direction); rows of one key are parts of one polygon.

* Overlap of pairs: a polygon is a signed sum of the areas below its edges, so the area that two share is the signed sum, over pairs of
  their edges, of the area below both. Edges are cut by slabs of x, and only polygons whose bounding boxes share a grid cell meet.
* Unions and repair: in a slab, edges are cut where any begins, ends or crosses another. Between two neighbouring cuts they don't cross,
  so running counts from the top down say how often each strip between two edges is covered.
* Dissolve: an edge that two children have in opposite directions cancels in one aggregation; what stays is linked to rings by
  pointer jumping, in a number of joins that is the logarithm of the longest ring.

Work grows with the edges: groups are never sorted or folded whole in one task, but by slab and cut. Strips and crossings join by merging: Spark takes
a frame of edges to be no larger than the file that they were made from, and would broadcast it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.store import discard, written

ENDS = ["ax", "ay", "bx", "by"]


def points() -> tuple[Column, Column]:
    """The two ends of an edge."""
    return F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))


def ring_edges(polygons: DataFrame, keys: list[str], polygon: str = "polygon", turned: bool = True) -> DataFrame:
    """keys, ax, ay, bx, by: the edges of all rings. turned: the inside is at the left of each edge, whatever the direction of the ring."""
    rings = polygons.select(*keys, F.posexplode(polygon).alias("at", "ring"))
    n = F.size("ring")
    edge = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", (i + 1) % n).alias("b")))
    back = geo.ring_area(F.col("ring")) * F.when(F.col("at") == 0, 1).otherwise(-1) < 0
    e = rings.filter(n > 1).select(*keys, (back if turned else F.lit(False)).alias("back"), F.explode(edge).alias("e"))
    a, b = F.when(F.col("back"), F.col("e.b")).otherwise(F.col("e.a")), F.when(F.col("back"), F.col("e.a")).otherwise(F.col("e.b"))
    return e.select(*keys, a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")).filter("ax <> bx OR ay <> by")


def signed(edges: DataFrame) -> DataFrame:
    """x0 < x1 with s: 1 for an edge that has the inside below, -1 above. Vertical edges bound no area below."""
    left = F.col("ax") < F.col("bx")
    of = lambda p, q: F.when(left, F.col(p)).otherwise(F.col(q))
    keys = [c for c in edges.columns if c not in ENDS]
    return edges.filter("ax <> bx").select(*keys, of("ax", "bx").alias("x0"), of("ay", "by").alias("y0"), of("bx", "ax").alias("x1"), of("by", "ay").alias("y1"), F.when(left, -1).otherwise(1).alias("s"))


def line_at(x: Column) -> Column:
    """y of an edge (x0, y0, x1, y1) at x; exact at its ends."""
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    return F.when(x == x0, y0).when(x == x1, y1).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def in_slabs(edges: DataFrame, width: float) -> DataFrame:
    """Signed edges cut at the multiples of width; slab is the number of each piece's column."""
    slab = F.sequence(F.floor(F.col("x0") / width).cast("long"), F.ceil(F.col("x1") / width).cast("long") - 1)
    e = edges.withColumn("slab", F.explode(slab))
    lo, hi = F.greatest("x0", F.col("slab") * F.lit(float(width))), F.least("x1", (F.col("slab") + 1) * F.lit(float(width)))
    e = e.withColumns({"lo": lo, "hi": hi}).withColumns({"at_lo": line_at(F.col("lo")), "at_hi": line_at(F.col("hi"))})
    return e.drop("x0", "y0", "x1", "y1").withColumnsRenamed({"lo": "x0", "at_lo": "y0", "hi": "x1", "at_hi": "y1"})


def cells(polygons: DataFrame, key: str, width: float, polygon: str = "polygon") -> DataFrame:
    """key, slab, row: the grid cells that a polygon's bounding box touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))
    b = polygons.select(key, geo.bounds(F.col(polygon)[0]).alias("b"))
    return b.withColumn("slab", F.explode(span(F.col("b.x0"), F.col("b.x1")))).withColumn("row", F.explode(span(F.col("b.y0"), F.col("b.y1")))).drop("b").distinct()


def below_both() -> Column:
    """Integral of the lower of two edges over the x they share."""
    lo, hi = F.greatest("x0", "u0"), F.least("x1", "u1")
    of = lambda p, x: F.col(f"{p}0y") + (F.col(f"{p}1y") - F.col(f"{p}0y")) * (x - F.col(f"{p}0")) / (F.col(f"{p}1") - F.col(f"{p}0"))
    a_lo, a_hi, b_lo, b_hi = of("x", lo), of("x", hi), of("u", lo), of("u", hi)
    d0, d1 = a_lo - b_lo, a_hi - b_hi
    apart = F.when(d0 * d1 >= 0, F.abs(d0 + d1) / 2).otherwise(F.try_divide(d0 * d0 + d1 * d1, 2 * (F.abs(d0) + F.abs(d1))))
    return (hi - lo) / 2 * ((a_lo + a_hi + b_lo + b_hi) / 2 - apart)


def overlaps(a: DataFrame, b: DataFrame, a_key: str, b_key: str, width: float) -> DataFrame:
    """a_key, b_key, overlap: the area shared by each two polygons that share any. width: of the grid, best about that of the smaller layer's polygons."""
    met = cells(a, a_key, width).join(cells(b, b_key, width), ["slab", "row"]).select(a_key, b_key, "slab").distinct()
    cut = lambda df, key: in_slabs(signed(ring_edges(df, [key])), width)
    ea = cut(a, a_key).withColumnsRenamed({"y0": "x0y", "y1": "x1y"})
    eb = cut(b, b_key).withColumnsRenamed({"x0": "u0", "y0": "u0y", "x1": "u1", "y1": "u1y", "s": "t"})
    j = met.join(ea, [a_key, "slab"]).join(eb, [b_key, "slab"]).filter("x0 < u1 AND u0 < x1")
    return j.groupBy(a_key, b_key).agg(F.sum(F.col("s") * F.col("t") * below_both()).alias("overlap")).filter("overlap > 1e-9")


def areas(polygons: DataFrame, key: str, polygon: str = "polygon") -> DataFrame:
    return polygons.groupBy(key).agg(F.sum(geo.polygon_area(F.col(polygon))).alias("area"))


def compared(a: DataFrame, b: DataFrame, a_key: str, b_key: str, width: float) -> DataFrame:
    """Each two polygons that share area: overlap, what of a lies outside b and of b outside a, Jaccard, and whether a lies in b."""
    j = overlaps(a, b, a_key, b_key, width).join(areas(a, a_key).withColumnRenamed("area", "a_area"), a_key).join(areas(b, b_key).withColumnRenamed("area", "b_area"), b_key)
    o, sa, sb = F.col("overlap"), F.col("a_area"), F.col("b_area")
    return j.select(a_key, b_key, "overlap", (sa - o).alias("a_outside"), (sb - o).alias("b_outside"), (o / (sa + sb - o)).alias("jaccard"), (sa - o <= 1e-9 * sa).alias("nested"))


def contained(children: DataFrame, parents: DataFrame, child: str, parent: str, width: float, bands: list[float], stray: float) -> DataFrame:
    """children (child, parent: the one it is assigned to, polygon) with share: how much of it lies there; band: the greatest of `bands` (falling) that it
    reaches, else 0; and for one below `stray`, actual: the parent that holds most of it, null where none holds any."""
    found = overlaps(children, parents.withColumnRenamed(parent, "held_by"), child, "held_by", width)
    per = found.groupBy(child).agg(F.max(F.struct("overlap", (-F.col("held_by")).alias("m"))).alias("most"), F.collect_list(F.struct("held_by", "overlap")).alias("all"))
    own = children.join(areas(children, child), child).join(per, child, "left")
    share = F.coalesce(F.get(F.filter("all", lambda x: x.held_by == F.col(parent)), 0)["overlap"], F.lit(0.0)) / F.col("area")
    own = own.withColumn("share", share)
    band = F.coalesce(*[F.when(F.col("share") >= x - 1e-12, F.lit(x)) for x in bands], F.lit(0.0))
    return own.select(child, parent, "share", band.alias("band"), F.when(F.col("share") < stray, -F.col("most.m")).alias("actual"))


def crossings(edges: DataFrame, group: list[str], cell: float) -> DataFrame:
    """group, x, y: the points where two edges of a group cross within both. Edges meet in grid cells, and a crossing counts in the cell that it lies in."""
    span = lambda p, q: F.sequence(F.floor(F.least(p, q) / cell).cast("long"), F.floor(F.greatest(p, q) / cell).cast("long"))
    e = edges.select(*group, *ENDS).withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    e = e.withColumn("e", F.struct(*ENDS))
    f = e.select(*group, "cx", "cy", F.col("e").alias("f"))
    j = e.select(*group, "cx", "cy", "e").join(f.hint("merge"), [*group, "cx", "cy"]).filter("e < f")
    side = lambda p, q, r: (F.col(f"{p}.bx") - F.col(f"{p}.ax")) * (F.col(f"{q}.{r}y") - F.col(f"{p}.ay")) - (F.col(f"{p}.by") - F.col(f"{p}.ay")) * (F.col(f"{q}.{r}x") - F.col(f"{p}.ax"))
    j = j.withColumns({"fa": side("f", "e", "a"), "fb": side("f", "e", "b"), "ea": side("e", "f", "a"), "eb": side("e", "f", "b")}).filter("fa * fb < 0 AND ea * eb < 0")
    t = F.try_divide("fa", F.col("fa") - F.col("fb"))  # the optimizer may move it before the filter
    j = j.select(*group, "cx", "cy", *[(F.col(f"e.a{c}") + t * (F.col(f"e.b{c}") - F.col(f"e.a{c}"))).alias(c) for c in "xy"])
    return j.filter((F.floor(F.col("x") / cell) == F.col("cx")) & (F.floor(F.col("y") / cell) == F.col("cy"))).select(*group, "x", "y")


def strips(edges: DataFrame, group: list[str], layers: list[str], width: float) -> DataFrame:
    """group, area, and for each layer how often the strip is covered by it. edges: group, ends, and a 0 or 1 for each layer that says whether
    the edge is of it. A polygon whose edges have the inside at their left covers once; with edges as they come, the parity counts."""
    e = in_slabs(signed(edges), width)
    met = crossings(edges, group, width).select(*group, F.floor(F.col("x") / width).cast("long").alias("slab"), "x")
    ends = e.select(*group, "slab", F.explode(F.array("x0", "x1")).alias("x"))
    cuts = ends.unionByName(met).groupBy(*group, "slab").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    inside = F.filter("xs", lambda x: (x >= F.col("x0")) & (x <= F.col("x1")))
    j = e.join(cuts.hint("merge"), [*group, "slab"]).withColumn("at", inside)
    j = j.withColumn("cut", F.explode(F.arrays_zip(F.slice("at", 1, F.size("at") - 1).alias("lo"), F.slice("at", 2, F.size("at") - 1).alias("hi"))))
    middle = line_at((F.col("cut.lo") + F.col("cut.hi")) / 2)
    sums = j.groupBy(*group, F.col("cut.lo").alias("lo"), F.col("cut.hi").alias("hi"), middle.alias("y")).agg(*[F.sum(F.col("s") * F.col(n)).alias(n) for n in layers], *[F.sum(n).alias(f"{n}_edges") for n in layers])
    down = Window.partitionBy(*group, "lo").orderBy(F.desc("y"))
    area = (F.col("hi") - F.col("lo")) * (F.col("y") - F.lead("y").over(down))
    out = sums.select(*group, area.alias("area"), *[F.sum(n).over(down).alias(n) for n in layers], *[(F.sum(f"{n}_edges").over(down) % 2).alias(f"{n}_parity") for n in layers])
    return out.filter("area > 0")


def union_coverage(parents: DataFrame, children: DataFrame, parent: str, width: float) -> DataFrame:
    """Each parent with children: the area of their union, of what of it lies in the parent (covered) and outside (spilt), of what two children claim
    (doubled), of the parent without child (gap), and coverage and spill as shares of the parent and of the union."""
    layer = lambda df, p, c: ring_edges(df, [parent]).withColumns({"own": F.lit(p), "child": F.lit(c)})
    of = lambda a, b: a.join(b.select(parent).distinct().hint("merge"), parent, "left_semi")
    edges = written(layer(of(parents, children), 1, 0).unionByName(layer(of(children, parents), 0, 1)))  # read three times
    s = strips(edges, [parent], ["own", "child"], width)
    total = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("area"))), F.lit(0.0))
    m = s.groupBy(parent).agg(total("child > 0").alias("union_area"), total("child > 0 AND own > 0").alias("covered"), total("child > 0 AND own <= 0").alias("spilt"), total("child > 1").alias("doubled"), total("own > 0 AND child <= 0").alias("gap"))
    return m.select("*", F.try_divide("covered", F.col("covered") + F.col("gap")).alias("coverage"), F.try_divide("spilt", F.col("union_area")).alias("spill"))


def repaired(polygons: DataFrame, key: str, width: float, polygon: str = "polygon") -> DataFrame:
    """Each polygon's plain area and its area by parity (what is inside an odd number of times), the change as a share, the points where its edges cross,
    the edges that it runs along more than once, and whether any of this makes it defective."""
    e = written(ring_edges(polygons, [key], polygon, turned=False))
    before = e.groupBy(key).agg(F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("before"))
    s = strips(e.withColumn("n", F.lit(1)), [key], ["n"], width).filter("n_parity = 1").groupBy(key).agg(F.sum("area").alias("after"))
    met = crossings(e, [key], width).groupBy(key).agg(F.count("*").alias("crossings"))
    a, b = points()
    twice = e.groupBy(key, F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).agg(F.count("*").alias("n")).filter("n > 1").groupBy(key).agg(F.count("*").alias("doubled_edges"))
    j = reduce(lambda x, y: x.join(y, key, "left"), [before, s, met, twice]).fillna(0, ["after", "crossings", "doubled_edges"])
    delta = F.abs(F.col("after") - F.col("before")) / F.greatest("before", "after")
    return j.select(key, "before", "after", F.coalesce(F.when(F.greatest("before", "after") > 0, delta), F.lit(0.0)).alias("delta"), "crossings", "doubled_edges").withColumn("defective", F.expr("delta > 1e-9 OR crossings > 0 OR doubled_edges > 0"))


def noded(edges: DataFrame, group: list[str], cell: float) -> DataFrame:
    """Edges cut at the ends of other edges of their group that lie on them, so that neighbours with different corners have equal edges."""
    span = lambda p, q: F.sequence(F.floor(F.least(p, q) / cell).cast("long"), F.floor(F.greatest(p, q) / cell).cast("long"))
    corners = edges.select(*group, F.col("ax").alias("x"), F.col("ay").alias("y")).distinct().withColumns({"cx": F.floor(F.col("x") / cell).cast("long"), "cy": F.floor(F.col("y") / cell).cast("long")})
    e = edges.select(*group, *ENDS).withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    t = ((F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))) / ((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    on = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) == (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))
    hit = e.join(corners, [*group, "cx", "cy"]).withColumn("t", t).filter(on & (F.col("t") > 0) & (F.col("t") < 1))
    places = hit.groupBy(*group, *ENDS).agg(F.array_sort(F.collect_set(F.struct("t", "x", "y"))).alias("places"))
    last = F.struct(F.lit(1.0).alias("t"), F.col("bx").alias("x"), F.col("by").alias("y"))
    first = F.struct(F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    all_of = F.concat(F.array(first), F.coalesce("places", F.array().cast("array<struct<t: double, x: double, y: double>>")), F.array(last))
    j = edges.join(places, [*group, *ENDS], "left").withColumn("all", all_of)
    piece = F.transform(F.sequence(F.lit(0), F.size("all") - 2), lambda i: F.struct(F.get("all", i).alias("p"), F.get("all", i + 1).alias("q")))
    return j.select(*group, F.explode(piece).alias("e")).select(*group, F.col("e.p.x").alias("ax"), F.col("e.p.y").alias("ay"), F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by"))


def outline(edges: DataFrame, group: list[str]) -> DataFrame:
    """The edges that don't cancel: those that a group has oftener in one direction than in the other."""
    a, b = points()
    net = edges.groupBy(*group, F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).agg(F.sum(F.when(a < b, 1).otherwise(-1)).alias("net")).filter("net <> 0")
    of = lambda p, q, c: F.when(F.col("net") > 0, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}"))
    return net.select(*group, of("p", "q", "x").alias("ax"), of("p", "q", "y").alias("ay"), of("q", "p", "x").alias("bx"), of("q", "p", "y").alias("by"))


def linked(edges: DataFrame, group: list[str]) -> DataFrame:
    """group, e, nxt: after each edge the one that goes on round the same area: at a corner of several, the first to the right of the way back."""
    turn = lambda x, y: F.atan2(y, x)
    e = edges.select(*group, F.struct(*ENDS).alias("e"))
    come = e.select(*group, F.col("e.bx").alias("x"), F.col("e.by").alias("y"), "e", turn(F.col("e.ax") - F.col("e.bx"), F.col("e.ay") - F.col("e.by")).alias("back"))
    go = e.select(*group, F.col("e.ax").alias("x"), F.col("e.ay").alias("y"), F.col("e").alias("nxt"), turn(F.col("e.bx") - F.col("e.ax"), F.col("e.by") - F.col("e.ay")).alias("out"))
    right = F.col("back") - F.col("out")
    right = F.when(right <= 1e-12, right + 2 * F.lit(3.141592653589793)).otherwise(right)
    return come.join(go, [*group, "x", "y"]).groupBy(*group, "e").agg(F.min_by("nxt", right).alias("nxt"))


def rings_of(edges: DataFrame, group: list[str]) -> DataFrame:
    """group, ring (an array of corners), area (positive outside, negative for a hole) of outline edges. Labels and then places are found by pointer
    jumping on written tables: every join doubles the stretch of a ring that an edge knows."""
    links = written(linked(edges, group))
    state = written(links.select(*group, "e", "nxt", F.least("e", "nxt").alias("label")))
    while True:
        far = state.select(*group, F.col("e").alias("nxt"), F.col("nxt").alias("jump"), F.col("label").alias("other"))
        step = written(state.join(far, [*group, "nxt"]).select(*group, "e", F.col("jump").alias("nxt"), F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("changed")))
        discard(state)
        state = step
        if state.filter("changed").isEmpty():
            break
    named = links.join(state.select(*group, "e", "label"), [*group, "e"])
    left = written(named.select(*group, "e", "label", F.when(F.col("nxt") != F.col("label"), F.col("nxt")).alias("nxt"), F.lit(1).cast("long").alias("left")))
    discard(state)
    while not left.filter("nxt IS NOT NULL").isEmpty():
        far = left.select(*group, F.col("e").alias("nxt"), F.col("nxt").alias("jump"), F.col("left").alias("more"))
        step = written(left.join(far, [*group, "nxt"], "left").select(*group, "e", "label", F.col("jump").alias("nxt"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        discard(left)
        left = step
    corners = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), F.col("e.ax").alias("x"), F.col("e.ay").alias("y")))), lambda c: F.array(c.x, c.y))
    area = F.sum(F.col("e.ax") * F.col("e.by") - F.col("e.bx") * F.col("e.ay")) / 2
    return left.groupBy(*group, "label").agg(corners.alias("ring"), area.alias("area")).drop("label")


def dissolve(children: DataFrame, parent: str, polygon: str = "polygon", cell: float | None = None) -> DataFrame:
    """parent, ring, area: the rings of each parent that its children make up together (children may touch, not overlap). cell: where neighbours have
    different corners along a border, the width of the grid in which their edges are cut at each other's corners first."""
    e = ring_edges(children, [parent], polygon)
    return rings_of(outline(noded(e, [parent], cell) if cell else e, [parent]), [parent])
