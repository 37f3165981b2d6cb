"""Contours, paths and the motion filter against plain loops and values by hand."""

import math
import random
from datetime import datetime, timedelta

import pytest

from envspark.operators import nowcast, paths

T0 = datetime(2024, 1, 1)


def test_contours_of_hand(spark):
    grid = {"plain": [[0, 10], [0, 10]], "saddle_low": [[10, 0], [0, 9]], "saddle_high": [[10, 4], [4, 10]], "hole": [[0, None], [10, 10]], "flat": [[5, 5], [5, 5]], "steep": [[0, 100], [0, 100]], "peak": [[0, 0, 0], [0, 8, 0], [0, 0, 0]]}
    rows = [(n, r, c, None if v is None else float(v)) for n, g in grid.items() for r, line in enumerate(g) for c, v in enumerate(line)]
    got = {}
    for r in paths.contours(spark.createDataFrame(rows, "name string, row_idx int, col_idx int, value double"), ["name"], 5.0, 10.0).collect():
        got.setdefault(r["name"], []).append((r["level"], round(r["x1"], 3), round(r["y1"], 3), round(r["x2"], 3), round(r["y2"], 3)))
    assert got["plain"] == [(5.0, 0.5, 0.0, 0.5, 1.0)]
    assert sorted(got["saddle_low"]) == [(5.0, 0.0, 0.5, 0.5, 0.0), (5.0, 1.0, 0.556, 0.556, 1.0)]  # the mean 4.75 is below: corners apart
    assert sorted(got["saddle_high"]) == [(5.0, 0.0, 0.833, 0.167, 1.0), (5.0, 0.833, 0.0, 1.0, 0.167)]  # joined through the middle
    assert "hole" not in got and "flat" not in got
    assert [s[0] for s in sorted(got["steep"])] == [5.0, 15.0, 25.0, 35.0]
    ends = [e for s in got["peak"] for e in (s[1:3], s[3:5])]
    assert len(got["peak"]) == 4 and all(ends.count(e) == 2 for e in ends)  # one closed line


def vertices(spark, rows):
    return spark.createDataFrame([(p, k, lon, lat, z, None if m is None else T0 + timedelta(minutes=m)) for p, k, lon, lat, z, m in rows], "path string, place int, lon double, lat double, z double, t timestamp_ntz")


def test_paths_follow_great_circles(spark):
    rows = [("meridian", 0, 0.0, 0.0, 100.0, 0), ("meridian", 1, 0.0, 10.0, 300.0, 10), ("seam", 0, 170.0, 10.0, None, None), ("seam", 1, -170.0, 20.0, None, None), ("one", 0, 190.0, 5.0, None, None),
            ("still", 0, 5.0, 5.0, 1.0, 0), ("still", 1, 5.0, 5.0, 1.0, 0), ("still", 2, 5.0, 5.0, 1.0, 4), ("bend", 0, 0.0, 60.0, None, None), ("bend", 1, 90.0, 60.0, None, None), ("bend", 2, 90.0, 61.0, None, None)]
    got = {}
    for r in paths.densify(vertices(spark, rows), 2.5, 2.5).orderBy("path", "n").collect():
        got.setdefault(r["path"], []).append(r)
    assert [round(r["lat"], 9) for r in got["meridian"]] == [0, 2.5, 5, 7.5, 10] and [r["z"] for r in got["meridian"]] == [100, 150, 200, 250, 300]
    assert [r["t"] for r in got["meridian"]] == [T0 + timedelta(seconds=150 * k) for k in range(5)]
    assert len(got["seam"]) == 9 and all(abs(r["lon"]) >= 170 for r in got["seam"]) and all(-180 < r["lon"] <= 180 for r in got["seam"])
    assert [r["lon"] for r in got["one"]] == [-170.0]
    assert [r["t"] for r in got["still"]] == [T0, T0 + timedelta(minutes=4)]  # equal samples are one
    assert max(r["lat"] for r in got["bend"]) == pytest.approx(math.degrees(math.atan(math.tan(math.radians(60)) / math.cos(math.radians(45)))), abs=1e-9)
    with pytest.raises(Exception, match="opposite points"):
        paths.densify(vertices(spark, [("x", 0, 0.0, 0.0, None, None), ("x", 1, 180.0, 0.0, None, None)]), 1.0, 1.0).collect()


def test_times_and_levels_of_samples(spark):
    samples = paths.densify(vertices(spark, [("p", 0, 0.0, 0.0, 1000.0, 0), ("p", 1, 0.0, 3.0, 700.0, 30)]), 1.0, 1.0)
    times, levels = ["2024-01-01 00:00:00", "2024-01-01 00:20:00", "2024-01-01 00:30:00"], [1000.0, 850.0, 700.0, 850.0]
    zm = paths.nodes(samples, times, levels, True, True).orderBy("n").collect()
    assert [((r["time"] - T0).seconds // 60, r["level"]) for r in zm] == [(0, 1000.0), (0, 850.0), (20, 850.0), (30, 700.0)]  # 10 minutes lie between: the earlier; 900 hPa at 850
    every = paths.nodes(samples, times, levels, False, False)
    assert every.count() == 4 * 3 * 3 and paths.nodes(samples, times, [], True, True).filter("level is null").count() == 4
    for bad in (lambda: paths.nodes(samples, times[1:], levels, True, True), lambda: paths.nodes(samples, times, [850.0], True, True)):
        with pytest.raises(Exception, match="outside of the axis"):
            bad().collect()


def test_values_along_a_path(spark):
    cells = spark.createDataFrame([(0, r, c, float(10 * r + c)) for r in range(4) for c in range(4) if (r, c) != (3, 3)], "frame int, row_idx int, col_idx int, value double")
    points = spark.createDataFrame([(0, "a", 10.5, 49.5), (0, "a", 11.0, 49.0), (0, "b", 11.0, 49.0), (0, "c", 13.2, 46.9), (1, "d", 11.0, 49.0), (0, "e", 40.0, 0.0)], "frame int, path string, lon double, lat double")
    got = [(r["path"], r["value"]) for r in paths.sampled(points, cells, ["frame"], 10.0, 50.0, 1.0, 1.0).orderBy("path", "lon").collect()]
    assert got == [("a", 0.0), ("a", 5.5), ("b", 5.5), ("c", 23.0), ("d", None), ("e", None)]


def plain_filter(vectors, rows, columns, k_most=30):
    out = {}
    for f in {v[0] for v in vectors}:
        own = {(r, c): (u, w) for g, r, c, u, w in vectors if g == f}
        kept = dict(own)
        if len(own) >= 4:
            k = min(k_most, len(own) - 1)
            for p in own:
                near = sorted((q for q in own if q != p), key=lambda q: ((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, q[0] * columns + q[1]))[:k]
                for axis in (0, 1):
                    values = sorted(own[q][axis] for q in near)
                    middle = values[k // 2]
                    mad = sorted(abs(v - middle) for v in values)[k // 2]
                    if abs(own[p][axis] - middle) > max(3 * 1.4826 * mad, 2.0):
                        kept.pop(p, None)
        if not kept:
            continue
        box = lambda p, have: [have[q] for q in ((p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if q in have]
        mean = lambda x: tuple(sum(v) / len(x) for v in zip(*x))
        field = dict(kept)
        while len(field) < rows * columns:
            field |= {p: mean(box(p, field)) for p in ((r, c) for r in range(rows) for c in range(columns)) if p not in field and box(p, field)}
        for _ in range(2):
            field = {p: field[p] if p in kept else mean(box(p, field)) for p in field}
        out |= {(f, *p): (*v, p in kept) for p, v in field.items()}
    return out


def test_motion_filter(spark):
    rng = random.Random(6)
    vectors = [(f, r, c, 3 + rng.gauss(0, 0.4) + (15 if rng.random() < 0.1 else 0), -2 + rng.gauss(0, 0.4)) for f in range(4) for r in range(8) for c in range(9) if rng.random() < (0.5, 0.9, 0.05, 1.0)[f]]
    vectors += [(9, 0, 0, 1.0, 1.0), (9, 7, 8, 50.0, 0.0)]
    got = {(r["frame"], r["block_row"], r["block_col"]): (r["d_row"], r["d_col"], r["measured"]) for r in nowcast.filter_motion(spark.createDataFrame(vectors, "frame int, block_row int, block_col int, d_row double, d_col double"), 8, 9).collect()}
    want = plain_filter(vectors, 8, 9)
    assert got.keys() == want.keys()
    assert all(got[k][2] == v[2] and got[k][:2] == pytest.approx(v[:2]) for k, v in want.items())
    assert sum(not v[2] for k, v in got.items() if k[0] == 3) >= 3  # outliers went
