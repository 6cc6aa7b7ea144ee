"""dBASE tables and shapefiles by ranges of records, the shared registry, and global order."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from plinth.operators import ordering, spatial, stats
from plinth.sources import layers, readers
from plinth.sources.registry import Registry

SQUARE = [[0.0, 0.0], [0.0, 4.0], [4.0, 4.0], [4.0, 0.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]


def test_layers_come_back(spark, tmp_path):
    day = datetime.date(2024, 2, 29)
    rows = [(i, f"naïve {i}" if i % 3 else None, i / 7 if i % 4 else None, i % 2 == 0, day, [SQUARE, HOLE] if i % 5 == 1 else [SQUARE] if i % 5 else None) for i in range(57)]
    df = spark.createDataFrame(rows, "key long, name string, share double, odd boolean, day date, polygon array<array<array<double>>>").repartition(3)
    folder = f"file://{tmp_path}/layer"
    layers.write_layer(df, folder, widths="name:12")
    assert sorted({f.rsplit(".", 1)[1] for f in os.listdir(tmp_path / "layer")}) == ["dbf", "shp", "shx"]
    back = layers.kept(layers.read_layer(spark, folder, records=10))
    assert sorted(back.select(*df.columns).collect(), key=lambda r: r.key) == sorted(df.collect(), key=lambda r: r.key)
    spark.dataSource.register(layers.Shapes)
    assert spark.read.format("shapes").option("records", 10).load(folder).rdd.getNumPartitions() >= 6
    # the older reader of whole files agrees
    old = readers.layer(spark, f"{folder}/*").collect()
    assert len(old) == 57 and {r.fields["key"] for r in old} == {str(i) for i in range(57)}


def test_dbf_schema_prunes_and_marks_deleted(spark, tmp_path):
    layers.write_dbf(spark.createDataFrame([(1, "a", False), (2, "b", True)], "key long, name string, _deleted boolean"), str(tmp_path / "t"))
    assert layers.read_dbf(spark, str(tmp_path / "t"), "name string, _deleted boolean").orderBy("name").collect() == [("a", False), ("b", True)]
    assert [(f.name, f.dataType.simpleString()) for f in layers.read_dbf(spark, str(tmp_path / "t")).schema] == [("key", "bigint"), ("name", "string"), ("_file", "string"), ("_number", "bigint"), ("_deleted", "boolean")]


def test_sources_are_found_from_other_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def there_and_back(name: str):
        layers.write_dbf(spark.createDataFrame([(1, name)], "key long, name string"), str(tmp_path / name))
        return name

    def back(name: str):
        return layers.read_dbf(spark, str(tmp_path / name), "name string").first().name

    for task in (there_and_back, back):
        with ThreadPoolExecutor(1) as pool:
            assert list(pool.map(task, ["one", "two"])) == ["one", "two"]


def test_long_texts_are_refused_not_cut(spark, tmp_path):
    with pytest.raises(Exception, match="more than 5 bytes"):
        layers.write_dbf(spark.createDataFrame([("sixsix",)], "name string"), str(tmp_path / "t"), widths="name:5")
    assert not [f for f in os.listdir(tmp_path / "t") if f.endswith(".dbf")] if (tmp_path / "t").exists() else True


def test_a_layer_with_a_shape_less_is_refused(spark, tmp_path):
    folder = tmp_path / "layer"
    layers.write_layer(spark.createDataFrame([(1, [SQUARE]), (2, [SQUARE])], "key long, polygon array<array<array<double>>>").coalesce(1), str(folder))
    index = next(f for f in folder.iterdir() if f.suffix == ".shx")
    index.write_bytes(index.read_bytes()[:-8])
    with pytest.raises(ValueError, match="differ"):
        layers.read_layer(spark, str(folder))


def test_registry_pins_a_snapshot(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    built = []

    def view(r):
        built.append(1)
        return r.table("t").selectExpr("id * 10 AS id")

    r = Registry.of(spark, str(tmp_path))
    assert Registry.of(spark, str(tmp_path)) is r and r.table("t") is r.table("t")
    assert sorted(x.id for x in r.view("tens", view).collect()) == [0, 10, 20]
    Registry(spark, str(tmp_path)).view("tens", view).collect()  # found by another one
    assert len(built) == 1 and not r.refresh()
    spark.range(5, 6).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    old = r.home(r.snapshot).removeprefix("file://")
    assert os.path.isdir(old) and r.refresh() and not os.path.isdir(old)
    assert sorted(x.id for x in r.view("tens", view).collect()) == [0, 10, 20, 50] and len(built) == 2


def test_order_by_locale_and_number(spark):
    words = ["item 10", "item 9", "Item 2", "éclair", "Zebra", "eclair", "apple", "item 009b", None, "ecology"]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int")
    got = ordering.numbered(df, [ordering.by_locale(ordering.natural(F.col("w"))).asc_nulls_last(), F.col("i").asc()], ways=3).collect()
    assert [r.w for r in sorted(got, key=lambda r: r.place)] == ["apple", "eclair", "éclair", "ecology", "Item 2", "item 9", "item 009b", "item 10", "Zebra", None]
    assert sorted(r.place for r in got) == list(range(1, 11))
    assert ordering.numbered(df.limit(0), [F.col("w")]).count() == 0


def test_lanes_are_the_greedy_ones(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, s := rng.randrange(300), s + rng.randrange(40)) for i in range(120)]
    got = {r.id: r.lane for r in spatial.lanes(spark.createDataFrame(rows, "k string, id int, s int, e int"), ["k"], "s", "e", ["id"]).collect()}
    for key in "ab":
        ends = []
        for _, i, s, e in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            at = next((n for n, x in enumerate(ends) if x < s), len(ends))
            ends[at : at + 1] = [e]
            assert got[i] == at


def test_order_statistics_agree(spark):
    df = spark.createDataFrame([("a", i * i % 17) for i in range(40)] + [("b", None), ("b", 3)], "k string, v int")
    picks = {"median": F.floor(F.col("n") / 2), "low": F.floor(F.col("n") / 10)}
    assert sorted(stats.order_statistics(df, ["k"], "v", picks).collect()) == sorted(stats.order_statistics(df, ["k"], "v", picks, bounded=True).collect())
