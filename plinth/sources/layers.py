"""dBASE tables and polygon shapefiles as Spark data sources, read by ranges of records and written by partitions.

    register(spark)
    spark.read.format("dbf").load(folder)          # the fields, and _file, _number, _deleted
    spark.read.format("shapes").load(folder)       # polygon, and _file, _number
    df.write.format("shapes").mode("append").save(folder)   # .shp, .shx and .dbf: polygon is the shape, the rest its attributes

A .dbf has records of one length, and a .shx the place of each shape, so a task reads its records only, whatever the file's size. Only the columns of a schema
that is given are decoded. Paths are those that Arrow's file systems open from every executor (a mount, s3, gs, hdfs); files of other stores are read whole by
readers.layer. Writers write beside the folder's files and name them at the commit, so that failed attempts leave none.

Defined results: blank fields are null; numbers without decimals of up to 18 digits are long, others double; a shape of another kind than
polygon, or an empty one, has a null polygon. Text is UTF-8 unless the option `encoding` says otherwise. Texts beyond a field's width (option `widths`, as "name:40,code:5";
254 else) raise an error; they are never cut.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

POLYGON = "array<array<array<double>>>"
#: Shape types that hold polygons; the file code and version of a shapefile.
POLYGON_KINDS, FILE_CODE, VERSION = (5, 15, 25), 9994, 1000


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def uri_files(path: str, end: str) -> list[str]:
    """Files of a folder, or one file, that end so, in order."""
    from pyarrow import fs

    system, at = opened(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(head + x.path for x in found if x.path.endswith(end) and x.type == fs.FileType.File)


def part_of(path: str, start: int, length: int | None = None) -> bytes:
    system, at = opened(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()


def header(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, where they begin, their length, and name, kind, width, decimals of the fields."""
    n, head, size = struct.unpack_from("<IHH", part_of(path, 0, 32), 4)
    data, fields, at = part_of(path, 32, head - 32), [], 0
    while at + 32 <= len(data) and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    return n, head, size, fields


def kind_of(kind: str, width: int, decimals: int) -> str:
    if kind == "N" and not decimals and width <= 18:
        return "long"
    return {"N": "double", "F": "double", "L": "boolean", "D": "date"}.get(kind, "string")


@dataclass
class Records(InputPartition):
    """Records first to last (not included) of a file."""

    path: str
    first: int
    last: int


def ranges(path: str, n: int, each: int) -> list[Records]:
    return [Records(path, i, min(i + each, n)) for i in range(0, n, each)]


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class Reader(DataSourceReader):
    end = ""

    def __init__(self, schema, options: dict):
        self.wanted, self.options, self.each = schema, options, int(options.get("records", 100_000))

    def count(self, path: str) -> int:
        raise NotImplementedError

    def columns(self, partition: Records) -> dict:
        """Function by column name that gives its values for the partition."""
        raise NotImplementedError

    def partitions(self) -> list[Records]:
        return [r for path in uri_files(self.options["path"], self.end) for r in ranges(path, self.count(path), self.each)] or [Records("", 0, 0)]

    def read(self, partition: Records):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.last <= partition.first:
            return
        schema, found = to_arrow_schema(self.wanted), self.columns(partition)
        n = partition.last - partition.first
        found |= {"_file": lambda: [stem(partition.path)] * n, "_number": lambda: list(range(partition.first, partition.last))}
        yield pa.RecordBatch.from_arrays([pa.array(found[f.name](), f.type) for f in schema], schema=schema)


class DbfReader(Reader):
    end = ".dbf"

    def count(self, path: str) -> int:
        return header(path)[0]

    def columns(self, partition: Records) -> dict:
        import datetime

        import numpy as np

        _, head, size, fields = header(partition.path)
        n, encoding = partition.last - partition.first, self.options.get("encoding", "utf-8")
        data = np.frombuffer(part_of(partition.path, head + partition.first * size, n * size), np.uint8).reshape(n, size)
        as_kind = {
            "long": int, "double": float, "boolean": lambda x: {"T": True, "Y": True, "F": False, "N": False}.get(x.upper()),
            "date": lambda x: datetime.date(int(x[:4]), int(x[4:6]), int(x[6:8])), "string": str,
        }

        def values(at: int, width: int, convert):
            texts = (bytes(x).decode(encoding).rstrip(" \0") for x in np.ascontiguousarray(data[:, at : at + width]))
            return [convert(t if convert is str else t.strip()) if t.strip() else None for t in texts]

        found, at = {"_deleted": lambda: (data[:, 0] == ord("*")).tolist()}, 1
        for name, kind, width, decimals in fields:
            found[name] = lambda at=at, width=width, convert=as_kind[kind_of(kind, width, decimals)]: values(at, width, convert)
            at += width
        return found


class ShapeReader(Reader):
    end = ".shp"

    def index(self, path: str, first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
        """Place and length in bytes of shapes, from the index beside the file."""
        data = part_of(path[:-1] + "x", 100 + 8 * first, None if last is None else 8 * (last - first))
        return [(2 * a, 2 * b) for a, b in struct.iter_unpack(">ii", data)]

    def count(self, path: str) -> int:
        system, at = opened(path[:-1] + "x")
        return (system.get_file_info(at).size - 100) // 8

    def columns(self, partition: Records) -> dict:
        import numpy as np

        def polygons() -> list:
            places = self.index(partition.path, partition.first, partition.last)
            start = min(a for a, _ in places)
            data, out = part_of(partition.path, start, max(a + 8 + n for a, n in places) - start), []
            for at, _ in places:
                body = at - start + 8
                (kind,) = struct.unpack_from("<i", data, body)
                if kind not in POLYGON_KINDS:
                    out.append(None)
                    continue
                parts, points = struct.unpack_from("<ii", data, body + 36)
                starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
                xy = np.frombuffer(data, "<f8", 2 * points, body + 44 + 4 * parts).reshape(-1, 2).tolist()
                out.append([xy[a:b] for a, b in zip(starts, starts[1:])] or None)
            return out

        return {"polygon": polygons}


@dataclass
class Files(WriterCommitMessage):
    """Names of the files that a task wrote, without and with the mark of an attempt."""

    names: list[tuple[str, str]]


def dbf_bytes(fields: list[tuple[str, str, int, int]], rows: list[tuple], deleted: list[bool], encoding: str) -> bytes:
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<B3BIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(fields), size)
    head += b"".join(struct.pack("<11sc4xBB14x", name.encode("latin-1")[:10], kind.encode(), width, decimals) for name, kind, width, decimals in fields) + b"\r"
    out = []
    for row, gone in zip(rows, deleted):
        out.append(b"*" if gone else b" ")
        for (name, kind, width, _), v in zip(fields, row):
            text = "" if v is None else v if kind == "C" else ("T" if v else "F") if kind == "L" else v.strftime("%Y%m%d") if kind == "D" else repr(v)
            data = text.encode(encoding)
            if len(data) > width:
                raise ValueError(f"{name}: {text!r} has more than {width} bytes")
            out.append(data.ljust(width) if kind in "CLD" else data.rjust(width))
    return head + b"".join(out) + b"\x1a"


def shape_bytes(polygons: list) -> tuple[bytes, bytes]:
    """The contents of .shp and .shx."""
    bodies = []
    for p in polygons:
        points = [x for ring in p or () for x in ring]
        if not points:
            bodies.append(struct.pack("<i", 0))
            continue
        xs, ys = [x[0] for x in points], [x[1] for x in points]
        starts = [sum(len(r) for r in p[:i]) for i in range(len(p))]
        bodies.append(struct.pack(f"<i4d2i{len(p)}i", 5, min(xs), min(ys), max(xs), max(ys), len(p), len(points), *starts) + struct.pack(f"<{2 * len(points)}d", *[v for x in points for v in x[:2]]))
    every = [x for p in polygons for ring in p or () for x in ring] or [[0.0, 0.0]]
    box = struct.pack("<8d", min(x[0] for x in every), min(x[1] for x in every), max(x[0] for x in every), max(x[1] for x in every), 0, 0, 0, 0)
    head = lambda size: struct.pack(">i20xi", FILE_CODE, size // 2) + struct.pack("<ii", VERSION, 5) + box
    shapes = b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))
    at, index = 100, []
    for b in bodies:
        index.append(struct.pack(">ii", at // 2, len(b) // 2))
        at += 8 + len(b)
    return head(100 + len(shapes)) + shapes, head(100 + 8 * len(bodies)) + b"".join(index)


class Writer(DataSourceArrowWriter):
    def __init__(self, schema, options: dict, shapes: bool):
        self.wanted, self.options, self.shapes = schema, options, shapes
        self.widths = dict((k, int(v)) for k, v in (x.split(":") for x in options.get("widths", "").split(",") if x))

    def fields(self) -> list[tuple[str, str, int, int]]:
        kinds = {"bigint": ("N", 18, 0), "int": ("N", 11, 0), "smallint": ("N", 6, 0), "double": ("F", 24, 15), "boolean": ("L", 1, 0), "date": ("D", 8, 0), "string": ("C", 254, 0)}
        named = [f for f in self.wanted if not f.name.startswith("_") and not (self.shapes and f.name == "polygon")]
        return [(f.name, kinds[f.dataType.simpleString()][0], self.widths.get(f.name, kinds[f.dataType.simpleString()][1]), kinds[f.dataType.simpleString()][2]) for f in named]

    def write(self, iterator) -> Files:
        fields, rows, gone, polygons = self.fields(), [], [], []
        for batch in iterator:
            c = {n: v.to_pylist() for n, v in zip(batch.schema.names, batch.columns)}
            rows += zip(*[c[f[0]] for f in fields]) if fields else [()] * batch.num_rows
            gone += [bool(x) for x in c.get("_deleted", [False] * batch.num_rows)]
            polygons += c["polygon"] if self.shapes else []
        if not rows:
            return Files([])
        name = f"part-{uuid.uuid4().hex}"
        parts = {".dbf": dbf_bytes(fields, rows, gone, self.options.get("encoding", "utf-8"))}
        if self.shapes:
            parts[".shp"], parts[".shx"] = shape_bytes(polygons)
        system, folder = opened(self.options["path"])
        system.create_dir(folder, recursive=True)
        for end, data in parts.items():
            with system.open_output_stream(f"{folder}/_{name}{end}.tmp") as f:
                f.write(data)
        return Files([(f"_{name}{end}.tmp", name + end) for end in parts])

    def commit(self, messages) -> None:
        system, folder = opened(self.options["path"])
        for a, b in (x for m in messages if m for x in m.names):
            system.move(f"{folder}/{a}", f"{folder}/{b}")

    def abort(self, messages) -> None:
        system, folder = opened(self.options["path"])
        for a, _ in (x for m in messages if m for x in m.names):
            system.delete_file(f"{folder}/{a}")


class Dbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> str:
        files = uri_files(self.options["path"], ".dbf")
        if not files:
            raise ValueError(f"no .dbf in {self.options['path']}")
        return ", ".join([f"`{name}` {kind_of(kind, width, decimals)}" for name, kind, width, decimals in header(files[0])[3]] + ["_file string", "_number long", "_deleted boolean"])

    def reader(self, schema) -> DataSourceReader:
        return DbfReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(schema, self.options, shapes=False)


class Shapes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return f"polygon {POLYGON}, _file string, _number long"

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(schema, self.options, shapes=True)


def register(spark: SparkSession) -> None:
    """Make both sources known. Spark looks such sources up in the session that is active in the calling thread, which a thread
    other than the one that made the session doesn't have; createDataFrame sets it."""
    spark.createDataFrame([], "none int")
    spark.dataSource.register(Dbf)
    spark.dataSource.register(Shapes)


def read_layer(spark: SparkSession, path: str, records: int = 100_000) -> DataFrame:
    """Shapes with their attributes, put together by file and record number; raises where a file has more of one than of the other."""
    register(spark)
    read = lambda kind: spark.read.format(kind).option("records", records).load(path)
    counts = [{stem(f): reader.count(f) for f in uri_files(path, reader.end)} for reader in (DbfReader(None, {}), ShapeReader(None, {}))]
    if wrong := {k for c in counts for k in c if counts[0].get(k) != counts[1].get(k)}:
        raise ValueError(f"records and shapes differ in {', '.join(sorted(wrong)[:5])}")
    return read("shapes").join(read("dbf"), ["_file", "_number"])


def write_layer(df: DataFrame, path: str, **options: str) -> None:
    register(df.sparkSession)
    df.write.format("shapes").options(**options).mode("append").save(path)


def write_dbf(df: DataFrame, path: str, **options: str) -> None:
    register(df.sparkSession)
    df.write.format("dbf").options(**options).mode("append").save(path)


def read_dbf(spark: SparkSession, path: str, schema: str | None = None, records: int = 100_000) -> DataFrame:
    """schema: only its columns are decoded."""
    register(spark)
    reader = spark.read.format("dbf").option("records", records)
    return (reader.schema(schema) if schema else reader).load(path)


def kept(layer: DataFrame) -> DataFrame:
    """Without the records that are marked as deleted, and without the columns of the source."""
    return layer.filter(~F.col("_deleted")).drop("_file", "_number", "_deleted")
