"""Joins of points with polygons, and sums over zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def met(places: DataFrame, rings: DataFrame, cell: float, ring: str) -> DataFrame:
    """x, y, ring: each place with the rings that hold it. Places meet the rings whose bounding box touches their grid cell, then the ray test decides.
    No pair outside a shared cell is ever made. The join merges: Spark takes the cells of the rings to be no larger than the file of the rings."""
    b = geo.bounds(F.col(ring))
    span = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))
    p = rings.withColumn("b", b).withColumn("cx", F.explode(span(F.col("b.x0"), F.col("b.x1")))).withColumn("cy", F.explode(span(F.col("b.y0"), F.col("b.y1")))).drop("b")
    q = places.withColumns({"cx": F.floor(F.col("x") / cell).cast("long"), "cy": F.floor(F.col("y") / cell).cast("long")})
    return q.join(p.hint("merge"), ["cx", "cy"]).filter(geo.contains(F.col(ring), F.col("x"), F.col("y"))).drop("cx", "cy")


#: Rows of one place or ring that go together as one array.
TOGETHER = 1000


def bundled(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `rows`: what else the rows of equal keys hold, as arrays of about TOGETHER."""
    rest = F.struct(*[c for c in df.columns if c not in keys]).alias("r")
    counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / TOGETHER).alias("ways"))
    dealt = df.select(*keys, rest).join(counts.hint("merge"), keys).withColumn("way", F.pmod(F.xxhash64("r"), F.col("ways")))
    return dealt.groupBy(*keys, "way").agg(F.collect_list("r").alias("rows")).drop("way")


def points_in(points: DataFrame, polygons: DataFrame, cell: float, ring: str = "ring") -> DataFrame:
    """Each (point, polygon) where the point (x, y) lies in the polygon's ring. A place that many points share, or a ring of many polygons, is tested once;
    their rows are carried along as arrays, so that what is joined is far less than the pairs that come of it."""
    at, of = bundled(points, ["x", "y"]), bundled(polygons, [ring]).withColumnsRenamed({"rows": "p_rows"})
    hits = met(points.select("x", "y").distinct(), polygons.select(ring).distinct(), cell, ring)
    j = hits.join(at, ["x", "y"]).join(of, ring)
    # a row becomes up to the square of TOGETHER, so rows are dealt to all tasks, whatever their bytes
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = j.repartition(n, F.xxhash64("x", "y", F.get("rows", 0), F.get("p_rows", 0)))
    j = j.select("x", "y", "p_rows", F.explode("rows").alias("r")).select("x", "y", "r", F.explode("p_rows").alias("p"))
    return j.select(*[F.col(c) if c in ("x", "y") else F.col(f"r.{c}").alias(c) for c in points.columns], *[F.col(f"p.{c}").alias(c) for c in polygons.columns if c != ring])


def zonal_sum(pixels: DataFrame, zones: DataFrame, zone: str, value: str, cell: float) -> DataFrame:
    """Sum and number of the pixels (x, y, value) whose centre lies in each zone; zones with none are kept with 0. The pixels of a place are summed first,
    and zones of one ring share their sums."""
    places = pixels.groupBy("x", "y").agg(F.sum(value).alias("total"), F.count("*").alias("pixels"))
    s = met(places, zones.select("ring").distinct(), cell, "ring").groupBy("ring").agg(F.sum("total").alias("total"), F.sum("pixels").alias("pixels"))
    of = zones.select(zone, "ring").join(s, "ring").groupBy(zone).agg(F.sum("total").alias("total"), F.sum("pixels").alias("pixels"))
    return zones.select(zone).join(of, zone, "left").fillna(0, ["total", "pixels"])


def allocated_sum(pixels: DataFrame, zones: DataFrame, parent: str, zone: str, value: str, totals: DataFrame, total: str, cell: float) -> DataFrame:
    """Each parent's known whole total (parent, total) shared out to its zones by the sums of their pixels: whole numbers that add up to it exactly.
    zones: parent, zone, ring. A parent none of whose zones has pixels is given null."""
    from .allocate import largest_remainder

    weights = zonal_sum(pixels, zones, zone, value, cell).join(zones.select(parent, zone), zone).join(totals, parent)
    return largest_remainder(weights.withColumn("weight", F.col("total")), [parent], zone, total, "weight").select(parent, zone, "weight", total, "allocated")


def lanes(df: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Lowest lane in which each interval of a group fits behind the last one there. Where no interval is open all lanes are free again, so a group is
    cut there (a running maximum of the ends), and each stretch is placed by itself: by a fold over its intervals in order, of which as
    many are held as follow each other without a gap."""
    row = F.struct(*[F.col(c) for c in (start, *order)], *[F.col(c) for c in df.columns if c not in {start, *order, *keys}])
    along = Window.partitionBy(*keys).orderBy(start, *order)
    open_until = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    cut = df.withColumn("t_new", F.when(F.col(start) > open_until, 1).otherwise(0))
    stretch = cut.withColumn("t_stretch", F.sum("t_new").over(along)).groupBy(*keys, "t_stretch").agg(F.array_sort(F.collect_list(row)).alias("t_rows"))
    ends = f"array<{df.schema[end].dataType.simpleString()}>"

    def place(at, x):
        free = F.array_position(F.transform(at.ends, lambda e: e < x[start]), True)
        lane = F.when(free > 0, free - 1).otherwise(F.size(at.ends)).cast("long")
        closed = F.transform(at.ends, lambda e, i: F.when(i == lane, x[end]).otherwise(e))
        return F.struct(F.when(free > 0, closed).otherwise(F.concat(at.ends, F.array(x[end]))).alias("ends"), F.concat(at.lanes, F.array(lane)).alias("lanes"))

    none = F.struct(F.array().cast(ends).alias("ends"), F.array().cast("array<bigint>").alias("lanes"))
    placed = stretch.withColumn("t_lanes", F.aggregate("t_rows", none, place, lambda at: at.lanes))
    out = placed.select(*keys, F.explode(F.arrays_zip("t_rows", "t_lanes")).alias("t"))
    return out.select(*[F.col(c) if c in keys else F.col(f"t.t_rows.{c}").alias(c) for c in df.columns], F.col("t.t_lanes").alias("lane"))


def worst_of(children: DataFrame, parent: str, rank: str, labels: list[str]) -> DataFrame:
    """A parent's status: the worst of its children's. labels go from best to worst; an unknown one counts as worst."""
    place = F.coalesce(*[F.when(F.col(rank) == x, F.lit(i)) for i, x in enumerate(labels)], F.lit(len(labels)))
    s = children.groupBy(parent).agg(F.max(place).alias("w"), F.count("*").alias("children"))
    return s.select(parent, F.coalesce(*[F.when(F.col("w") == i, F.lit(x)) for i, x in enumerate(labels)], F.lit("unknown")).alias("status"), "children")
