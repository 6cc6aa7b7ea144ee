"""Readers, sinks and streams on files written here."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from plinth.operators import export
from plinth.sources import readers
from plinth.streaming import events


def test_csv_quotes_bom_and_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿code,name,value\n1,"a ""b"", c",5\n2,"  two   words ",\n', encoding="utf-8")
    got = readers.csv(spark, str(tmp_path / "a.csv"), "code int, name string, value long", squash=True).orderBy("code").collect()
    assert [tuple(r) for r in got] == [(1, 'a "b", c', 5), (2, "two words", None)]


def test_json_array_and_ndjson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": ""}, {"a": 2, "b": "x"}], indent=1))
    df = readers.json_array(spark, str(tmp_path / "a.json"), "a int, b string")
    assert sorted(map(tuple, df.collect())) == [(1, None), (2, "x")]
    export.write_ndjson(df, str(tmp_path / "nd"))
    assert readers.ndjson(spark, str(tmp_path / "nd"), "a int, b string").count() == 2


def test_panel_union_and_csv_sink(spark, tmp_path):
    wide = spark.createDataFrame([("a", 1, 2)], "code string, `2020` long, `2021` long")
    assert sorted(map(tuple, readers.unpivot_years(wide, ["code"]).collect())) == [("a", 2020, 1), ("a", 2021, 2)]
    both = readers.union_all([spark.createDataFrame([(1, ["x", "y"])], "a int, tags array<string>"), spark.createDataFrame([(2, "z")], "a int, b string")])
    assert both.columns == ["a", "tags", "b"]
    export.write_csv(both, str(tmp_path / "out"))
    assert '"x|y"' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))


def test_bundles_and_manifest(spark, tmp_path):
    obs = spark.createDataFrame([("k1", "s", 2, 5), ("k1", "s", 1, 4), ("k2", "t", 1, 3)], "k string, series string, yr int, v int")
    nested = export.bundles(obs, "k", "series", ["yr", "v"])
    assert [(o.yr, o.v) for o in nested.filter("k = 'k1'").first().series[0].observations] == [(1, 4), (2, 5)]
    export.write_bundles(obs, str(tmp_path / "b"), "k")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/b/*/*.json")
    assert export.manifest(files).count() == 2 and all(len(r.sha256) == 64 for r in export.manifest(files).collect())


def test_features_and_embedded_json(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}))
    row = readers.features(spark, str(tmp_path / "g.json"), "name: string").first()
    assert row.name == "A" and row.geometry_type == "Polygon" and json.loads(row.coordinates)[0][1] == [1, 0]
    html = spark.createDataFrame([('<script type="application/json">{"a": 1}</script><script>no</script>',)], "h string")
    assert html.select(readers.embedded_json(F.col("h"))).first()[0] == ['{"a": 1}']


def dbf(fields, records):
    head = 32 + 32 * len(fields) + 1
    size = 1 + sum(w for _, _, w in fields)
    columns = b"".join(n.encode().ljust(11, b"\0") + k + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in fields)
    return struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(records), head, size) + columns + b"\r" + b"".join(records)


def shp(shapes):
    out = b""
    for i, rings in enumerate(shapes):
        points = [p for r in rings for p in r]
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        body = struct.pack("<i4dii", 5, 0, 0, 9, 9, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        out += struct.pack(">ii", i + 1, len(body) // 2) + body
    return b"\0" * 100 + out


def square(x, y, size, clockwise=True):
    ring = [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]
    return ring if clockwise else ring[::-1]


def test_shapefile_layers(spark, tmp_path):
    fields = [("NAME", b"C", 6), ("POP", b"N", 4)]
    (tmp_path / "l1.dbf").write_bytes(dbf(fields, [b" Alpha   12", b"*G\xe9ne      ", b" Beta     7"]))
    (tmp_path / "l1.shp").write_bytes(shp([[square(0, 0, 8), square(1, 1, 2, False), square(20, 0, 3)], [square(0, 0, 1, False)], [square(5, 5, 1)]]))
    (tmp_path / "l2.dbf").write_bytes(dbf(fields, [b" Gamma    1"]))
    (tmp_path / "l2.shp").write_bytes(shp([[square(3, 3, 1)]]))
    rows = readers.layer(spark, str(tmp_path / "l*")).orderBy("base", "number").collect()
    assert [(r.number, r.deleted, r.fields["NAME"], r.numbers["POP"]) for r in rows] == [(0, False, "Alpha", 12.0), (1, True, "Géne", None), (2, False, "Beta", 7.0), (0, False, "Gamma", 1.0)]
    assert [[len(p) for p in r.polygons] for r in rows] == [[2, 1], [1], [1], [1]] and rows[0].polygons[0][1][0] == [1.0, 1.0]
    (tmp_path / "l2.shp").write_bytes(shp([]))
    with pytest.raises(ValueError):
        readers.layer(spark, str(tmp_path / "l*"))


def test_documents_of_a_folder_by_their_fields(spark, tmp_path):
    for name, state in (("a-check", "verified"), ("b-check", "open"), ("c-other", "verified")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"state": state, "n": len(name)}, indent=1))
    got = readers.documents(spark, f"{tmp_path}/*-check.json", "state string, n long", F.col("state") == "verified").collect()
    assert [(r.n, r.file.rsplit("/", 1)[1]) for r in got] == [(7, "a-check.json")]


def test_pretty_json_manifest_and_its_check(spark, tmp_path):
    obs = spark.createDataFrame([("ward", "k1", 5, None), ("ward", "k2", 4, "x"), ("county", "k1", 3, "y")], "level string, code string, v int, note string")
    export.write_pretty(obs, str(tmp_path / "p"))
    text = "".join(x.read_text() for x in (tmp_path / "p").glob("*.txt"))
    assert '\n  "note" : null' in text and text.count('"level"') == 3
    stated = export.write_with_manifest(obs, str(tmp_path / "b"), "level", "code")
    assert sorted((r.level, r.code) for r in stated.collect()) == [("county", "k1"), ("ward", "k1"), ("ward", "k2")]
    assert spark.read.option("header", True).csv(str(tmp_path / "b" / "manifest")).count() == 3
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("e", 1, "q")], "file string, bytes long, sha256 string")
    said = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y"), ("c", 3, "w"), ("d", 1, "q")], "file string, bytes long, sha256 string")
    assert {r.file: r.finding for r in export.verified(files, said).collect()} == {"a": "ok", "b": "bytes differ", "c": "checksum differs", "d": "missing", "e": "not in the manifest"}


def test_upserts_go_on_with_a_new_checkpoint(spark, tmp_path):
    schema, path = "k long, at long, v string", str(tmp_path / "table")
    put = events.upsert_sink(path, "k", "at")
    put(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema), 5)
    put(spark.createDataFrame([(2, 3, "c")], schema), 0)
    put(spark.createDataFrame([(2, 2, "late"), (3, 1, "d")], schema), 0)
    want = [(1, 1, "a"), (2, 3, "c"), (3, 1, "d")]
    assert sorted(map(tuple, events.current(spark, path, schema).collect())) == want
    (tmp_path / "table" / "v3").mkdir()  # a version that was not finished
    put(spark.createDataFrame([(3, 1, "d")], schema), 1)
    assert sorted(map(tuple, events.current(spark, path, schema).collect())) == want and len(events.versions(spark, path)) == 2


def test_streams(spark, tmp_path, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), schema), "ts", ["event_type"], "1 day", "40 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == rows.count()
    once = events.first_versions(events.read_events(spark, str(tmp_path / "in"), schema), "ts", ["user_id", "event_type"], "40 days")
    q = once.writeStream.foreachBatch(events.upsert_sink(str(tmp_path / "table"), "user_id", "ts")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert events.current(spark, str(tmp_path / "table"), schema).count() == rows.select("user_id").distinct().count()
