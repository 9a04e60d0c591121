"""Layout along the curve, the GeoJSON data source, and sources and sinks that no query needs."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from hexflow.functions import grid
from hexflow.operators import fields, nodes, raster
from hexflow.plans import simulation
from hexflow.schema import TABLES
from hexflow.sources import geojson, layout
from hexflow.sources import tables as S
from hexflow.sources.geojson_source import SCHEMA, CellGeoJson

BOX = (12.0, 12.0, 15.0, 15.0)


def features(spark, n=4000, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (r.uniform(0, 100), r.uniform(0, 100)) if i % 3 else (50.0, 50.0)  # a third at one place
        ring = [{"x": x + a, "y": y + b} for a, b in ((0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5))]
        rows.append((i, r.choice(("park", "water", "ocean")), *[None] * 8, "Polygon", [ring] if i % 50 else None))
    return rows, spark.createDataFrame(rows, TABLES["features"])


def meets(rings):
    xs, ys = [p["x"] for p in rings[0]], [p["y"] for p in rings[0]]
    return min(xs) <= BOX[2] and max(xs) >= BOX[0] and min(ys) <= BOX[3] and max(ys) >= BOX[1]


def test_a_small_area_opens_few_files(spark, tmp_path):
    rows, df = features(spark)
    path = str(tmp_path / "f")
    layout.arrange(df.repartition(7), path, per_file=100)
    parts = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(parts) >= 35
    found = layout.scan(spark, path, BOX)
    assert {r.feature_id for r in found.collect()} == {x[0] for x in rows if x[11] and x[1] != "ocean" and meets(x[11])}
    assert 1 <= len(found.inputFiles()) <= 4
    assert "PushedFilters: [" in found._jdf.queryExecution().toString()
    assert layout.scan(spark, path).count() == sum(bool(x[11]) and x[1] != "ocean" for x in rows)
    most = max(r.n for r in spark.read.parquet(f"{path}/{layout.MANIFEST}").collect())
    assert most < 400  # the crowded place is many files
    assert layout.scan(spark, path, (500.0, 500.0, 501.0, 501.0)).count() == 0


def test_layout_of_nothing_and_of_one_point(spark, tmp_path):
    _, df = features(spark, 60)
    layout.arrange(df.limit(0), str(tmp_path / "none"))
    assert layout.scan(spark, str(tmp_path / "none"), BOX).count() == 0
    layout.arrange(df.where("feature_id = 3"), str(tmp_path / "one"))
    assert layout.scan(spark, str(tmp_path / "one"), (49.0, 49.0, 51.0, 51.0)).count() <= 1


def test_curve_keeps_neighbours_near(spark):
    got = {(r.x, r.y): r.c for r in spark.range(256).selectExpr("cast(id % 16 as int) x", "cast(id / 16 as int) y").select("x", "y", layout.curve(F.col("x"), F.col("y")).alias("c")).collect()}
    want = {(x, y): sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(4)) for x in range(16) for y in range(16)}
    assert got == want


def test_scan_of_features_by_plain_boxes(spark, tmp_path):
    rows, df = features(spark, 300)
    layout.arrange(df, str(tmp_path / "f"))
    got = S.scan_features(spark, str(tmp_path / "f"), BOX)
    assert {r.feature_id for r in got.collect()} == {x[0] for x in rows if x[11] and x[1] != "ocean" and meets(x[11])}
    assert S.scan_features(spark, str(tmp_path / "f")).count() == sum(bool(x[11]) and x[1] != "ocean" for x in rows)


@pytest.fixture
def source(spark):
    spark.dataSource.register(CellGeoJson)
    return spark


def cell_rows(n=500):
    r = random.Random(3)
    return [(i * 11, i % 40, i // 40, r.choice((None, i)), r.choice((None, r.random())), r.choice((1.0, 0.1 + 0.2, 999999.0))) for i in range(n)]


@pytest.mark.parametrize(("size", "n"), [(40, 40), (997, 500), (1 << 20, 500)])
def test_cells_round_trip_whatever_the_ranges(source, tmp_path, size, n):
    rows, path = cell_rows(n), str(tmp_path / "cells")
    source.createDataFrame(rows, SCHEMA).repartition(5).write.format("cell_geojson").mode("append").option("path", path).save()
    got = source.read.format("cell_geojson").option("path", path).option("range", str(size)).load()
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == rows
    assert sorted(f for f in os.listdir(path) if not f.endswith(".geojsonl")) == ["_SUCCESS"]
    f = json.loads(open(f"{path}/{next(x for x in os.listdir(path) if x.endswith('.geojsonl'))}").readline())
    assert f["type"] == "Feature" and len(f["geometry"]["coordinates"][0]) == 7


def test_appended_overwritten_and_empty(source, tmp_path):
    path = str(tmp_path / "cells")
    write = lambda rows, mode: source.createDataFrame(rows, SCHEMA).write.format("cell_geojson").mode(mode).option("path", path).save()
    read = lambda: source.read.format("cell_geojson").option("path", path).load().count()
    write(cell_rows(10), "append")
    write(cell_rows(15), "append")
    assert read() == 25
    write(cell_rows(4), "overwrite")
    assert read() == 4
    write([], "overwrite")
    assert read() == 0


def test_a_failed_write_leaves_nothing(source, tmp_path):
    path = str(tmp_path / "cells")
    bad = source.range(20).selectExpr("id as cell_id", "cast(id as int) q", "cast(0 as int) r", "id as score", "1.0D affordance", "if(id = 13, cast(raise_error('no') as double), 1.0D) friction")
    with pytest.raises(Exception, match="no"):
        bad.write.format("cell_geojson").mode("append").option("path", path).save()
    assert not os.path.exists(path) or os.listdir(path) == []


def test_area_key(spark):
    rings = [[{"x": 1.23456789, "y": -2.0}, {"x": 3.0, "y": 4.5}, {"x": 0.5, "y": 0.0}]]
    df = spark.createDataFrame([(rings,)], "rings array<array<struct<x: double, y: double>>>")
    assert df.select(raster.aoi_key(F.col("rings"), 15).alias("k")).first().k == "0.500000:-2.000000:3.000000:4.500000:15"


def test_pins_as_points(spark):
    df = spark.createDataFrame([(2, 2, "dual", 7)], "q int, r int, type string, weight int")
    f = json.loads(geojson.pin_features(df).first().feature)
    assert f["geometry"]["type"] == "Point" and f["geometry"]["coordinates"] == pytest.approx([3.0, math.sqrt(3)]) and f["properties"] == {"type": "dual", "weight": 7}


def test_spherical_bearings(spark):
    cases = [((0, 0, 1, 0), 0), ((0, 0, 0, 1), 90), ((0, 0, -1, 0), 180), ((0, 0, 0, -1), 270), ((40.4169, -3.7035, 40.4269, -3.6935), 37.28)]
    df = spark.createDataFrame([tuple(map(float, c)) for c, _ in cases], "a double, b double, c double, d double")
    assert [r.x for r in df.select(grid.spherical_bearing("a", "b", "c", "d").alias("x")).collect()] == pytest.approx([w for _, w in cases], abs=0.05)


def test_missing_fields_are_added(spark):
    cells = spark.createDataFrame([(i, q, r, i, 1.0) for i, (q, r) in enumerate(grid.disk_offsets(3))], "cell_id long, q int, r int, ord int, friction double")
    two, one = (spark.createDataFrame([(d,) for d in x], "dest long") for x in ((3, 20), (3,)))
    have = fields.gradient(cells, one)
    got = simulation.missing_fields(two, have, cells)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fields.gradient(cells, two).collect()))
    assert simulation.missing_fields(one, have, cells).count() == have.count()


def test_bounds_skip_what_is_not_finite(spark):
    rows = [(1.0, 2.0), (float("nan"), 5.0), (3.0, float("inf")), (-4.0, 0.5), (None, 1.0)]
    assert tuple(nodes.bounds(spark.createDataFrame(rows, "x double, y double")).first()) == (-4.0, 0.5, 1.0, 2.0)
    assert tuple(nodes.bounds(spark.createDataFrame([], "x double, y double")).first()) == (None,) * 4
