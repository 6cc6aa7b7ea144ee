"""Queries over tables larger than the smallest ones, where groups have many rows and places repeat, against their SQL."""

import duckdb
import pytest

from plinth.plans.catalogue import ORACLE, QUERIES
from tests.oracle import assert_same, views


@pytest.fixture(scope="module")
def larger(sf_dir, tmp_path_factory):
    """The customers and suppliers of sf0.001 repeated with shifted keys."""
    path = tmp_path_factory.mktemp("larger")
    for table, key, name, times in (("customer", "c_custkey", "c_name", 6), ("supplier", "s_suppkey", "s_name", 250)):
        shift = f"i * (SELECT max({key}) + 1 FROM '{sf_dir}/{table}.parquet')"
        duckdb.sql(f"COPY (SELECT * EXCLUDE (i) REPLACE ({key} + {shift} AS {key}, {name} || '-' || i AS {name}) FROM '{sf_dir}/{table}.parquet', range({times}) r(i)) TO '{path}/{table}.parquet' (FORMAT parquet)")
    for table in ("nation", "region"):
        duckdb.sql(f"COPY (FROM '{sf_dir}/{table}.parquet') TO '{path}/{table}.parquet' (FORMAT parquet)")
    return str(path)


def same(spark, folder, name):
    assert_same(QUERIES[name](spark, folder), views(folder), ORACLE[name])


def test_feature_collections_of_a_nation_in_several_files(spark, larger):
    same(spark, larger, "q_geojson_files")


def test_union_coverage_broadcasts_no_edges(spark, larger):
    same(spark, larger, "q_union_coverage")
    plan = QUERIES["q_union_coverage"](spark, larger)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["q_point_in_polygon", "q_zonal_sum", "q_spatial_allocation"])
def test_places_that_repeat(spark, larger, name):
    same(spark, larger, name)


def test_a_place_or_ring_of_many_rows_is_tested_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from plinth.operators import spatial

    test = spatial.geo.contains
    monkeypatch.setattr(spatial, "TOGETHER", 7, raising=False)
    tested = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(held):
        tested.add(1)
        return held

    monkeypatch.setattr(spatial.geo, "contains", lambda ring, x, y: counted(test(ring, x, y)))
    square = F.array(*[F.array(F.floor(F.col("id") / 1000) + float(x), F.lit(float(y))) for x, y in ((0, 0), (8, 0), (8, 8), (0, 8))])
    zones = spark.range(40).select(F.col("id").alias("zone"), square.alias("ring"))
    points = spark.range(90).select("id", (F.col("id") % 3 * 5.0 + 0.5).alias("x"), F.lit(1.0).alias("y"), F.lit(2).alias("value"))
    got = spatial.points_in(points, zones, 4.0).collect()
    assert sorted((r.id, r.zone) for r in got) == [(i, z) for i in range(90) if i % 3 < 2 for z in range(40)] and {(r.x, r.y, r.value) for r in got} == {(0.5, 1.0, 2), (5.5, 1.0, 2)}
    sums = spatial.zonal_sum(points, zones, "zone", "value", 4.0).collect()
    assert sorted((r.zone, r.total, r.pixels) for r in sums) == [(z, 120, 60) for z in range(40)] and 2 <= tested.value <= 8


def test_rectangles_that_are_alike_meet_once(spark):
    from pyspark.sql import functions as F

    from plinth.operators import joins

    a = spark.range(300).select("id", *[(F.col("id") % 3 * 10 + d).alias(f"a_{c}") for c, d in (("x0", 0), ("y0", 0), ("x1", 8), ("y1", 8))])
    b = spark.range(5, 400).select(F.col("id").alias("key"), *[(F.col("id") % 5 * 5 + d).alias(f"b_{c}") for c, d in (("x0", 1), ("y0", 0), ("x1", 9), ("y1", 8))])
    joined, join = [], joins.box_overlap
    try:
        joins.box_overlap = lambda x, y, cell: joined.append((x.count(), y.count())) or join(x, y, cell)
        got = joins.best_box(a, b, "id", "key", 4, 0.25).collect()
    finally:
        joins.box_overlap = join
    assert joined == [(3, 5)]
    assert sorted((r.id, r.key, r.overlap, round(r.iou, 6)) for r in got) == [(i, (5, 7, 9)[i % 3], 56, round(56 / 72, 6)) for i in range(300)]


def test_best_rectangles(spark, larger):
    same(spark, larger, "q_bbox_iou")


@pytest.fixture
def tiles(monkeypatch):
    """Small tiles, so that also these tables make several, of which few are rows."""
    from plinth.operators import similar

    for name, value in (("CHUNK", 12), ("FEW", 60)):
        monkeypatch.setattr(similar, name, value)


def test_alike_equals_brute_force():
    import random

    from plinth.operators import similar
    from tests.test_layout_and_names import distance

    rng = random.Random(5)
    for letters, longest in (("abcd", 30), ("ab", 9), ("abcdé漢x", 15), ("".join(map(chr, range(300, 700))), 9), ("abc", 80)):
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        names = sorted({word(rng.randrange(longest)) for _ in range(40)})
        others = sorted({x[:2] + x[3:] if i % 2 else x + word(1) for i, x in enumerate(names)} | {word(rng.randrange(longest)) for _ in range(20)} | {""})
        costs = {(i, j): distance(a, b) / max(len(a), len(b), 1) for i, a in enumerate(names) for j, b in enumerate(others)}
        for most in (0.13, 0.24, 0.45, 0.8, 0.95):
            got = [(int(i), int(j), float(c)) for a, b, cost in similar.alike(names, others, most) for i, j, c in zip(a, b, cost)]
            assert sorted(got) == sorted((i, j, c) for (i, j), c in costs.items() if c <= most)


def test_fuzzy_match_broadcasts_no_names(spark, larger, tiles):
    same(spark, larger, "q_fuzzy_match")
    plan = QUERIES["q_fuzzy_match"](spark, larger)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan


def no_grams(*_):
    raise AssertionError("names that are this far apart meet in tiles")


def test_similar_names_in_tiles(spark, larger, tiles):
    same(spark, larger, "q_similar_names")
    plan = QUERIES["q_similar_names"](spark, larger)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["q_er_names", "q_er_spatial"])
def test_resolution_in_tiles(spark, larger, tiles, monkeypatch, name):
    from plinth.operators import similar

    monkeypatch.setattr(similar, "candidates", no_grams)
    same(spark, larger, name)


def test_workers_need_not_import_the_comparison(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from plinth.operators import similar

    (tmp_path / "g").write_bytes(cloudpickle.dumps(similar.alike))
    code = f"import pickle; f = pickle.load(open({str(tmp_path / 'g')!r}, 'rb')); print([len(a) for a, b, c in f(['abcdef', 'x'], ['abcdeg'], 0.3)])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=tmp_path, env={"PATH": ""}).stdout.strip() == "[1]"
