"""Tests of the findings of the third round (not run on the code before them)."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from envspark.operators import aggregates, curvilinear, gridding, grids, joins, paths, tiles
from envspark.plans import places, registry  # noqa: F401
from envspark.sources import catalog, documents

OBS = "seq long, station_id long, time timestamp_ntz, parameter string, value double"


@pytest.fixture()
def tables(spark, monkeypatch):
    """Sets the views that registered queries read."""
    given = {}
    monkeypatch.setattr(registry, "view", lambda spark, sf_dir, name: given[name])
    return given


def at(text):
    return datetime.datetime.fromisoformat(text)


def test_f7_the_first_listed_of_equal_keys(spark):
    rows = [("a/r_05_20240102.nc", b, p) for b, p in ((40, 3), (30, 2), (90, 9))] + [("a/r_07_20240102.nc", 5, 8), ("b/r_07_20240102.nc", 7, 9), ("b/r_07_20240102.nc", 6, 4)]
    for given in (rows, rows[::-1]):
        files = spark.createDataFrame(given, "key string, bytes long, place long").coalesce(1)
        got = {(r["lead"], r["key"], r["bytes"]) for r in catalog.catalog(files, "r_{lead}_%Y%m%d.nc", place="place").collect()}
        assert got == {(5, "a/r_05_20240102.nc", 30), (7, "b/r_07_20240102.nc", 6)}


def test_f6_steps_within_one_second_and_stations_without_a_step(spark, tables):
    times = ["2024-01-02 23:59:50.100", "2024-01-02 23:59:50.900", "2024-01-03 00:00:20"]
    rows = [(i, 1, at(t), "click", 1.0) for i, t in enumerate(times)] + [(9, 2, at("2024-01-03 05:00:00"), "view", 1.0)]
    asked = spark.createDataFrame([(1, at("2024-01-03"))], "key long, want timestamp_ntz")
    steps = spark.createDataFrame([(1, at(t)) for t in times], "key long, time timestamp_ntz")
    assert [r["time"] for r in joins.nearest_time(asked, steps).collect()] == [at(times[0])]
    tables.update(obs=spark.createDataFrame(rows, OBS), areas=None)
    assert {(r["key"], r["want"].day, r["time"]) for r in registry.QUERIES["join_nearest_time"](spark, "").collect()} == {(1, 2, at(times[0])), (1, 3, at(times[0]))}


def test_f8_places_are_decimals_and_late_reports_count_though_the_mean_stays(spark, tables):
    from decimal import Decimal

    grid = spark.range(400).select("id", *registry.grid_places(F.floor(F.col("id") / 20), F.col("id") % 20, 1930, 5930))
    assert all((r["lon"], r["lat"]) == (float(Decimal("19.3") + r["id"] // 20 * Decimal("0.65")), float(Decimal("59.3") + r["id"] % 20 * Decimal("0.6"))) for r in grid.collect())
    rows = [(1, 7, at("2024-01-03 05:10:00"), "click", 4.0), (400, 7, at("2024-01-03 05:20:00"), "view", 4.0), (2, 7, at("2024-01-03 06:10:00"), "click", 4.0)]
    tables.update(obs=spark.createDataFrame(rows, OBS), stations=spark.createDataFrame([(7, 19.3, 59.3)], "station_id long, lon double, lat double"))
    got = registry.QUERIES["interp_revision"](spark, "").collect()
    assert {r["time"] for r in got} == {at("2024-01-03 05:00:00")} and {r["estimate"] for r in got} == {4.0}


def _far(a, b):
    h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(min(1.0, h)))


PLACED = "station_id long, lon double, lat double"


def test_f1_f3_the_nearest_of_crowds_and_lone_stations(spark):
    rng = random.Random(3)
    anywhere = lambda n: [(i, rng.uniform(-180, 180) if i % 4 else rng.choice([-180.0, 180.0, 179.99, 0.0]), rng.choice([rng.uniform(-90, 90), 89.9, -90.0, 0.001])) for i in range(n)]
    stations = anywhere(120) + [(200 + i, 25 + rng.gauss(0, 0.03), 60 + rng.gauss(0, 0.02)) for i in range(150)] + [(400 + i, 25.0, 60.0) for i in range(40)]
    points = anywhere(80) + [(200 + i, 25 + rng.gauss(0, 0.2), 60 + rng.gauss(0, 0.1)) for i in range(60)] + [(300, 25.0, 60.0)]
    df = spark.createDataFrame(stations, PLACED).repartition(4).cache()
    for metres, k in ((30_000.0, 1), (300_000.0, 8), (2_500_000.0, 3), (15_000_000.0, 2)):
        got = {}
        for r in joins.nearest(spark.createDataFrame(points, "id int, lon double, lat double"), df, metres, k).collect():
            got.setdefault((r["lon"], r["lat"]), []).append((round(r["distance"], 3), r["station_id"]))
        for p in points:
            want = sorted((d, s[0]) for s in stations if (d := _far(p, s)) <= metres)[:k]
            assert sorted(got.get(p[1:], [])) == sorted((round(d, 3), s) for d, s in want), (p, metres, k)


@pytest.mark.parametrize("join", ["leave_one_out", "nearest_station"])
def test_f1_f3_pairs_do_not_grow_with_the_square_of_a_crowd(spark, monkeypatch, join):
    met, plain = spark.sparkContext.accumulator(0), joins.haversine
    count = F.udf(lambda x: (met.add(1), x)[1], "double")
    monkeypatch.setattr(joins, "haversine", lambda lon1, lat1, lon2, lat2: plain(count(lon1), lat1, lon2, lat2))
    n = 2000  # within reach of each other, ten to a spot
    crowd = spark.createDataFrame([(i, 20 + (i // 10 * 79 % 200) / 100, 60 + (i // 10 * 61 % 200) / 200) for i in range(n)], PLACED)
    if join == "leave_one_out":
        found = gridding.leave_one_out(crowd, crowd.select("station_id", F.col("lat").alias("value")), 400_000.0)
    else:
        found = joins.nearest_station(crowd.withColumnRenamed("station_id", "id"), crowd, 400_000.0)
    assert len(found.collect()) == n
    assert 0 < met.value < 300 * n  # all pairs are n * n


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f4_f5_values_are_not_gathered_after_the_join(spark):
    points = spark.createDataFrame([(1, 0.25, 0.5), (2, 1.5, 0.5), (3, 1.5, 1.5), (4, 9.0, 9.0)], "id int, x double, y double")
    cells = spark.createDataFrame([(f, r, c, 1.0 * f + 10 * r + c) for f in (0, 1) for r in (0, 1) for c in (0, 1)], "frame int, row_idx int, col_idx int, value double")
    found = grids.position(points, cells, ["frame"])
    assert {tuple(r) for r in found.collect()} == {(1, 0, 5.25), (1, 1, 6.25), (2, 0, 1.0), (2, 1, 2.0), (3, 0, 11.0), (3, 1, 12.0)}
    assert _plan(found).index("Join") < _plan(found).index("Aggregate")


def test_f2_samples_meet_their_squares_once(spark):
    points = spark.createDataFrame([(1, 0, 20.9, 60.1), (1, 1, 50.0, 60.1)], "path int, frame int, lon double, lat double")
    cells = spark.createDataFrame([(0, r, c, 10.0 * r + c) for r in (0, 1) for c in (0, 1)], "frame int, row_idx int, col_idx int, value double")
    found = paths.sampled(points, cells, ["frame"], 20.0, 61.0, 1.0, 1.0)
    assert {r["lon"]: r["value"] and round(r["value"], 9) for r in found.collect()} == {20.9: 4.4, 50.0: None}
    assert _plan(found).count("Join") == 1


@pytest.mark.parametrize("n", [1, 2, 5, 8, 84])
def test_f2_the_nearest_time_by_halving(spark, n):
    start = at("2024-01-01")
    axis = [start + datetime.timedelta(minutes=5 * i + i * i % 3) for i in range(n)]
    asked = sorted({start + (axis[-1] - start) * i / 40 for i in range(41)} | {a + (b - a) / 2 for a, b in zip(axis, axis[1:])})
    samples = spark.createDataFrame([(1, i, 0.0, 0.0, None, t) for i, t in enumerate(asked)], "path int, n int, lon double, lat double, z double, t timestamp_ntz")
    got = {r["n"]: r["time"] for r in paths.nodes(samples, [str(t) for t in axis], [], True, False).collect()}
    assert got == {i: min(axis, key=lambda a: (abs(a - t), a)) for i, t in enumerate(asked)}


def test_f9_strips_are_cut_once(spark):
    ring = "array(array(struct(20.0D AS x, 60.0D AS y), struct(23.0D AS x, 60.0D AS y), struct(23.0D AS x, 61.0D AS y), struct(20.0D AS x, 61.0D AS y)))"
    cut = tiles.tile_polygons(spark.sql(f"SELECT 1 AS id, {ring} AS rings FROM range(1)"), ["id"], 8)
    assert not [line for line in _plan(cut).split("\n") if "Filter" in line and "transform" in line.split("Filter", 1)[1] and "tile_" in line]


def test_f12_places_in_cells_are_worked_out_once(spark):
    grid = spark.createDataFrame([(c, r, 20.0 + c, 60.0 + r) for c in range(3) for r in range(3)], "col int, row int, lon double, lat double")
    found = curvilinear.locate(spark.createDataFrame([(1, 20.5, 60.5)], "id int, lon double, lat double"), grid, 3, 3)
    assert not [line for line in _plan(found).split("\n") if "Filter" in line and "try_divide" in line.split("Filter", 1)[1]]


def test_f13_documents_are_read_once(spark):
    found = documents.alerts(spark.createDataFrame([("<alert/>",)], "value string"))
    assert found.collect() == [] and _plan(found).count("from_xml") + _plan(found).count("xmltostructs") == 1


def test_f10_windows_are_held_as_numbers():
    import tracemalloc

    import pyarrow as pa

    n = 200_000
    rows = pa.table({"ended": [i % 3 > 0 for i in range(n)], "severity": pa.array([i % 5 for i in range(n)], pa.int32()), "onset": [i // 3 for i in range(n)], "e": [i // 3 + 50 + i % 7 for i in range(n)]})
    tracemalloc.start()
    got = aggregates._instants(rows, 1000, 255)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(set(got)) == 255
    assert peak < 150 * n  # a dictionary a row alone is more


def test_f11_spans_are_few_blocks_each_bucket_once(spark):
    spans = [(a, b) for a in range(-5, 40) for b in range(a, a + 30)]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", joins._blocks(F.col("a"), F.col("b")).alias("blocks")).collect()
    for r in got:
        each = [x["bucket"] * 2 ** x["level"] + i for x in r["blocks"] for i in range(2 ** x["level"])]
        assert sorted(each) == list(range(r["a"], r["b"] + 1)), r
        assert len(r["blocks"]) <= 9
