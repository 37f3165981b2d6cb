"""Places on irregular grids: round trips, and Newton's method over all cells."""

import math
import random

import pytest

from envspark.operators import curvilinear

GRID, POINTS = "col int, row int, lon double, lat double", "id int, lon double, lat double"


def unit(lon, lat):
    x, y = math.radians(lon), math.radians(lat)
    return math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)


def lonlat(v):
    return math.degrees(math.atan2(v[1], v[0])), math.degrees(math.asin(v[2] / math.hypot(*v)))


def bent(lon, lat, n, step=0.01):
    """n x n nodes of a sheared and bent patch on the plane that touches the globe at lon, lat."""
    x, y = math.radians(lon), math.radians(lat)
    p, e, m = unit(lon, lat), (-math.sin(x), math.cos(x), 0.0), (-math.sin(y) * math.cos(x), -math.sin(y) * math.sin(x), math.cos(y))
    at = lambda u, v: lonlat([p[i] + step * (u + 0.3 * v + 0.02 * u * v) * e[i] + step * (v - 0.15 * u + 0.01 * u * u) * m[i] for i in range(3)])
    return [(c, r, *at(c - n / 2, r - n / 2)) for r in range(n) for c in range(n)], at


def newton(lon, lat, corners):
    x, y = math.radians(lon), math.radians(lat)
    p, e, m = unit(lon, lat), (-math.sin(x), math.cos(x), 0.0), (-math.sin(y) * math.cos(x), -math.sin(y) * math.sin(x), math.cos(y))
    dot = lambda a, b: sum(i * j for i, j in zip(a, b))
    a, b, c, d = [complex(dot(q, e), dot(q, m)) / dot(q, p) for q in corners]
    s = t = 0.5
    for _ in range(30):
        f = a + s * (b - a) + t * (c - a) + s * t * (a - b - c + d)
        ds, dt = (b - a) + t * (a - b - c + d), (c - a) + s * (a - b - c + d)
        det = ds.real * dt.imag - ds.imag * dt.real
        s, t = s - (f.real * dt.imag - f.imag * dt.real) / det, t - (ds.real * f.imag - ds.imag * f.real) / det
    return s, t


def found(spark, points, grid, n):
    return {r["id"]: (r["col"], r["row"]) for r in curvilinear.locate(spark.createDataFrame(points, POINTS), spark.createDataFrame(grid, GRID), n, n).collect()}


@pytest.mark.parametrize("lon, lat", [(25.0, 60.0), (179.97, -17.0), (10.0, 89.9), (0.0, -90.0)])
def test_nodes_and_inner_points(spark, lon, lat):
    n = 7
    grid, at = bent(lon, lat, n)
    rng = random.Random(n)
    points = [(k, x + 360 * (k % 3 - 1), y) for k, (_, _, x, y) in enumerate(grid)]
    inner = [(rng.uniform(0, n - 1.001), rng.uniform(0, n - 1.001)) for _ in range(60)]
    points += [(1000 + k, *at(u - n / 2, v - n / 2)) for k, (u, v) in enumerate(inner)]
    got = found(spark, points, grid, n)
    for k, (c, r, _, _) in enumerate(grid):
        assert got[k] == (pytest.approx(c, abs=1e-7), pytest.approx(r, abs=1e-7))
    node = {(c, r): unit(x, y) for c, r, x, y in grid}
    for i, x, y in points[len(grid):]:
        ways = [(c + s, r + t) for c in range(n - 1) for r in range(n - 1) for s, t in [newton(x, y, [node[c, r], node[c + 1, r], node[c, r + 1], node[c + 1, r + 1]])] if -1e-9 <= s <= 1 + 1e-9 and -1e-9 <= t <= 1 + 1e-9]
        if ways:  # a bent outer border leaves some points just out of every cell
            assert got[i] == (pytest.approx(ways[0][0], abs=1e-7), pytest.approx(ways[0][1], abs=1e-7))
    assert all(v[0] is not None for v in got.values())


def test_edges_gaps_and_points_without_a_place(spark):
    grid = [(c, r, 20.0 + c * 0.1, 60.0 + r * 0.1) for r in range(6) for c in range(6) if (c, r) != (3, 3)] + [(3, 3, math.nan, 60.3)]
    points = [(0, 19.95, 60.25), (1, 19.85, 60.25), (2, 19.7, 60.25), (3, 20.62, 60.61), (4, 20.3, 60.3), (5, 20.23, 60.28), (6, 20.15, 60.2), (7, None, 60.0), (8, 20.0, 95.0), (9, math.nan, 60.1), (10, -160.0, -60.0)]
    got = found(spark, points, grid, 6)
    assert got[0] == (pytest.approx(-0.5, abs=1e-3), pytest.approx(2.5, abs=1e-3)) and got[1][0] == pytest.approx(-1.5, abs=2e-3)
    assert got[2] == (None, None)  # three nodes past the edge
    assert got[3] == (pytest.approx(6.2, abs=1e-2), pytest.approx(6.1, abs=1e-2))  # past a corner
    assert got[4] == got[5] == (None, None)  # in cells whose corner has no position
    assert got[6] == (pytest.approx(1.5, abs=1e-3), pytest.approx(2.0, abs=1e-3))
    assert all(got[i] == (None, None) for i in (7, 8, 9, 10)) and len(got) == 11


def test_a_border_takes_the_first_cell_and_no_grid_no_place(spark):
    grid = [(c, r, 20.0 + c * 0.1, 0.0 + r * 0.1) for r in range(3) for c in range(3)]
    assert found(spark, [(0, 20.1, 0.05), (1, 20.1, 0.1)], grid, 3) == {0: (pytest.approx(1.0, abs=1e-6), pytest.approx(0.5, abs=1e-6)), 1: (pytest.approx(1.0, abs=1e-6), pytest.approx(1.0, abs=1e-6))}
    assert found(spark, [(0, 20.1, 0.05)], grid[:2], 3) == {0: (None, None)}
    assert curvilinear.locate(spark.createDataFrame([], POINTS), spark.createDataFrame(grid, GRID), 3, 3).count() == 0
