import math
import random

import pytest

from lenscape.operators import geo


def km(a, b):
    (x, y), (u, v) = a, b
    h = math.sin(math.radians(x - u) / 2) ** 2 + math.cos(math.radians(x)) * math.cos(math.radians(u)) * math.sin(math.radians(y - v) / 2) ** 2
    return 2 * geo.RADIUS_KM * math.asin(math.sqrt(min(1, h)))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rng = random.Random(2)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(2000)]
    points += [(3000 + i, 48.1 + rng.random() / 50, 11.5 + rng.random() / 50) for i in range(700)] + [(9000, 90.0, 0.0), (9001, -90.0, 5.0), (9002, 0.0, -180.0)]
    path = f"file://{tmp_path_factory.mktemp('geo')}/points"
    df = spark.createDataFrame(points, "photo_id long, lat double, lon double")
    geo.write(df, path)
    return points, path, df


def test_radius_equals_brute_force(spark, kept):
    points, path, _ = kept
    for at, far in (((48.11, 11.51), 1.0), ((0.0, 179.9), 900.0), ((89.0, 10.0), 500.0), ((-60.0, -179.0), 3000.0), ((10.0, 10.0), 25_000.0), ((5.0, 5.0), 0.0)):
        got = {r.photo_id for r in geo.within(spark, path, *at, far).collect()}
        assert got == {i for i, x, y in points if km(at, (x, y)) <= far}, (at, far)


def test_few_files_are_read(spark, kept):
    _, path, df = kept
    near = geo.within(spark, path, 48.11, 11.51, 20.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "LessThanOrEqual(lat" in plan
    scan = near._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    assert scan.selectedPartitions().totalNumberOfFiles() * 20 < len(spark.read.parquet(path).inputFiles())


def test_counts_add_up(spark, kept):
    points, _, df = kept
    got = {(r.zoom, r.x, r.y): r.photos for r in geo.counts(df, 6).collect()}
    want = {}
    for z in range(7):
        for _, lat, lon in points:
            key = z, math.floor((lon + 180) / 360 * 2**z), min(math.floor((lat + 90) / 180 * 2**z), 2**z - 1)
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_what_is_on_the_map(spark):
    rows = [(1, "12.5", "180"), (2, None, "3"), (3, "91", "0"), (4, "x", "0"), (5, "-90", "-180")]
    exif = spark.createDataFrame(rows, "photo_id long, gps_latitude string, gps_longitude string")
    assert [tuple(r) for r in geo.located(exif).collect()] == [(1, 12.5, -180.0), (5, -90.0, -180.0)]
    assert geo.counts(geo.located(exif.limit(0)), 3).collect() == []
