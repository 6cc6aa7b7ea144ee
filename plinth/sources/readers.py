"""Readers with explicit schemas, and cells of HTML tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text is null from the edge on; the formats can't tell them apart."""
    return df.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema])


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole files, each one JSON array of records."""
    return blank_to_null(spark.read.schema(schema).option("multiLine", True).json(path))


def ndjson(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return blank_to_null(spark.read.schema(schema).json(path))


def csv(spark: SparkSession, path: str, schema: StructType | str, squash: bool = False) -> DataFrame:
    """Quoted CSV with a header; a byte-order mark is dropped by Spark's reader; squash trims cells and joins runs of space."""
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    if squash:
        df = df.select(*[F.trim(F.regexp_replace(f.name, r"\s+", " ")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema])
    return blank_to_null(df)


def unpivot_years(df: DataFrame, ids: list[str]) -> DataFrame:
    """A wide panel with a column a year as (ids, year, value)."""
    years = [c for c in df.columns if c.isdigit()]
    return df.unpivot(ids, years, "year", "value").withColumn("year", F.col("year").cast("long"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON features: properties (DDL of a struct) and the geometry's type and coordinates as text."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), "f.geometry.coordinates")


def embedded_json(html: F.Column, kind: str = "application/json") -> F.Column:
    """Bodies of the page's script elements of a kind, in order."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<script[^>]*type="{kind}"[^>]*>(.*?)</script>'), F.lit(1))


def html_cells(pages: DataFrame, key: str, html: str, tags: tuple[str, ...] = ("td", "th", "li")) -> DataFrame:
    """key, tag, position, text of the page's cells and list items; JVM functions only."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<({'|'.join(tags)})\b[^>]*>(.*?)</\1>"), F.lit(0))
    cells = pages.select(key, F.posexplode(found).alias("position", "cell"))
    tag = F.lower(F.regexp_extract("cell", r"^<([a-zA-Z0-9]+)", 1))
    body = F.trim(F.regexp_replace(F.regexp_replace("cell", r"<[^>]*>", ""), r"\s+", " "))
    return cells.select(key, tag.alias("tag"), F.col("position").cast("long").alias("position"), body.alias("text"))


def documents(spark: SparkSession, glob: str, schema: StructType | str, keep: F.Column) -> DataFrame:
    """One JSON document a file, of all files that the glob names, where the condition on its fields holds; with the file it came from."""
    df = spark.read.schema(schema).option("multiLine", True).json(glob)
    return blank_to_null(df.withColumn("file", F.input_file_name())).filter(keep)


def dbf_records(files: DataFrame) -> DataFrame:
    """Records of dBASE files from a binaryFile scan: path, number (from 0), deleted (whether it is marked so), fields as text, and
    numbers: the fields of types N and F as numbers. Files are read in parallel; one file is one row."""

    def parse(batches):
        import struct

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                n, head, size = struct.unpack_from("<IHH", data, 4)
                columns, at = [], 32
                while at < head - 1 and data[at] != 0x0D:
                    columns.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]))
                    at += 32
                for i in range(n):
                    record = data[head + i * size : head + (i + 1) * size]
                    pos, fields, numbers = 1, {}, {}
                    for name, kind, width in columns:
                        fields[name] = record[pos : pos + width].decode("latin-1").strip() or None
                        if kind in "NF":
                            numbers[name] = None if fields[name] is None else float(fields[name])
                        pos += width
                    rows.append((path, i, record[:1] == b"*", fields, numbers))
            yield pd.DataFrame(rows, columns=["path", "number", "deleted", "fields", "numbers"])

    return files.select("path", "content").mapInPandas(parse, "path string, number long, deleted boolean, fields map<string,string>, numbers map<string,double>")


def turn(ring: list) -> float:
    """Twice the signed area of a closed ring: negative for one that runs clockwise, which is an outer one in a shapefile."""
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))


def holds(ring: list, point: list) -> bool:
    x, y = point
    return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:])) % 2 == 1


def polygons_of(rings: list) -> list:
    """Rings as polygons (outer ring, then its holes): a hole goes to the first outer ring that holds its first point, or else stands for
    itself; where no ring runs as an outer one, the largest is it. Open rings are closed; those of fewer than four points are left out."""
    whole = [r if r[0] == r[-1] else [*r, r[0]] for r in rings if len(r) >= 4]
    outer = [r for r in whole if turn(r) < 0] or sorted(whole, key=lambda r: -abs(turn(r)))[:1]
    found = [[r] for r in outer]
    for hole in (r for r in whole if not any(r is o for o in outer)):
        home = next((f for f in found[: len(outer)] if holds(f[0], hole[0])), None)
        if home is None:
            found.append([hole])
        else:
            home.append(hole)
    return found


def shp_rings(files: DataFrame) -> DataFrame:
    """Polygon records of shapefiles from a binaryFile scan: path, number (from 0), rings as arrays of points (rounded to a millionth), and the polygons
    that they make. An empty shape has none."""

    def parse(batches):
        import struct

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                at, number = 100, 0
                while at + 8 <= len(data):
                    (words,) = struct.unpack_from(">i", data, at + 4)
                    body = at + 8
                    (kind,) = struct.unpack_from("<i", data, body)
                    rings = []
                    if kind in (5, 15, 25):
                        parts, points = struct.unpack_from("<ii", data, body + 36)
                        starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
                        xy = [round(v, 6) for v in struct.unpack_from(f"<{2 * points}d", data, body + 44 + 4 * parts)]
                        rings = [[[xy[2 * i], xy[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:])]
                    rows.append((path, number, rings, polygons_of(rings)))
                    at, number = body + 2 * words, number + 1
            yield pd.DataFrame(rows, columns=["path", "number", "rings", "polygons"])

    return files.select("path", "content").mapInPandas(parse, "path string, number long, rings array<array<array<double>>>, polygons array<array<array<array<double>>>>")


def layer(spark: SparkSession, base: str) -> DataFrame:
    """Shapefile layers (base may be a glob): geometry and attributes put together by file and record number, deleted records included with their
    mark. Raises if a file's counts differ."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "").alias("base")
    binary = lambda end: spark.read.format("binaryFile").load(f"{base}.{end}")
    attributes = dbf_records(binary("dbf")).select(stem, "number", "deleted", "fields", "numbers")
    shapes = shp_rings(binary("shp")).select(stem, "number", "rings", "polygons")
    counts = attributes.groupBy("base").agg(F.count("*").alias("a")).join(shapes.groupBy("base").agg(F.count("*").alias("s")), "base", "full_outer")
    wrong = counts.filter(~F.col("a").eqNullSafe(F.col("s"))).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0].base}: {wrong[0].a} records, {wrong[0].s} shapes")
    return shapes.join(attributes, ["base", "number"])
