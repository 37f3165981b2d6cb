"""Cells of radar volumes and their tracks against plain loops and values by hand."""

import math
import random

import pytest

from envspark.operators import cells3d

VOXELS = "scan int, i_r int, i_a int, i_h int, dbz double"


def plain_parts(wet, grid):
    """Column -> part by sets: grown, shrunk, flooded."""
    turn = lambda a: a % grid.n_a if grid.wraps else a
    inside = lambda r, a: 0 <= r < grid.n_r and 0 <= a < grid.n_a
    near = lambda r, a: {(r + i, turn(a + j)) for i in (-1, 0, 1) for j in (-1, 0, 1) if inside(r + i, turn(a + j))}
    grown = {q for p in wet for q in near(*p)}
    shut = {p for p in grown if near(*p) <= grown}
    part = {}
    for p in sorted(shut):
        if p not in part:
            stack, part[p] = [p], p[0] * grid.n_a + p[1]
            while stack:
                r, a = stack.pop()
                for q in ((r - 1, a), (r + 1, a), (r, turn(a - 1)), (r, turn(a + 1))):
                    if q in shut and q not in part:
                        part[q] = p[0] * grid.n_a + p[1]
                        stack.append(q)
    return part


@pytest.mark.parametrize("grid", [cells3d.Grid(12, 10, 1000.0, 500.0), cells3d.Grid(9, 11, 1000.0, 500.0, turn=2.0), cells3d.Grid(5, 2, 1000.0, 500.0), cells3d.Grid(4, 1, 1000.0, 500.0)])
def test_columns_equal_a_plain_loop(spark, grid):
    rng = random.Random(grid.n_r)
    rows = [(s, r, a, h, rng.choice([20.0, 34.0, 35.0, 50.0])) for s in range(5) for r in range(grid.n_r) for a in range(grid.n_a) for h in range(2) if rng.random() < (0.05 + 0.1 * s)]
    rows += [(0, grid.n_r, 0, 0, 60.0), (0, -1, 0, 0, 60.0), (0, 0, None, 0, 60.0), (0, 0, 0, 0, None), (0, 1, 0, 0, math.nan)]
    got = {(c["scan"], c["i_r"], c["i_a"]): (c["part"], c["n"] or 0) for c in cells3d.cell_columns(spark.createDataFrame(rows, VOXELS), ["scan"], grid).collect()}
    want = {}
    for s in range(5):
        mine = [(r, a) for t, r, a, _, v in rows if t == s and v is not None and v >= 35 and r in range(grid.n_r) and a is not None]
        want |= {(s, *p): (part, mine.count(p)) for p, part in plain_parts(set(mine), grid).items()}
    assert got == want and len({p for p, _ in want.values()}) > 1 - (grid.n_a == 1)


GRID = cells3d.Grid(20, 36, 5000.0, 1000.0)


def cells(spark, rows, **limits):
    sites = spark.createDataFrame([(24.5, 60.5, 100.0, 1)], "lon double, lat double, height double, site int")
    voxels = spark.createDataFrame([(1, *r) for r in rows], "site int, " + VOXELS)
    found = cells3d.storm_cells(voxels, ["site", "scan"], GRID, sites, ["site"], **limits)
    return sorted((c.asDict() for c in found.collect()), key=lambda c: (c["scan"], c["label"]))


def test_a_cell_over_north_is_one(spark):
    block = [(0, r, a, h, 45.0) for r in (8, 9) for a in (35, 0) for h in (1, 2)]
    [c] = cells(spark, [*block, (0, 8, 0, 2, 52.0)][:-1])
    area = sum(5000 * (r + 0.5) * 5000 * 2 * math.pi / 36 for r in (8, 9)) * 2
    assert c["area_km2"] == pytest.approx(area / 1e6) and c["volume_km3"] == pytest.approx(area * 2000 / 1e9)
    assert c["lon"] == pytest.approx(24.5, abs=1e-9) and c["lat"] > 60.8  # straight to the north
    assert (c["base"], c["echo_top"], c["height"]) == (1100.0, 3100.0, pytest.approx(2100.0))
    assert c["vil"] == pytest.approx(2 * 3.44e-6 * (10**4.5) ** (4 / 7) * 1000)
    assert (c["west"], c["east"]) == (pytest.approx(-50000 * math.sin(math.radians(10))), pytest.approx(50000 * math.sin(math.radians(10))))
    assert c["south"] == pytest.approx(40000 * math.cos(math.radians(10))) and c["north"] == pytest.approx(50000.0)


def test_heavier_voxels_draw_the_centroid_and_hail_is_capped(spark):
    [c] = cells(spark, [(0, 10, 9, 0, 40.0), (0, 10, 9, 3, 60.0)], least_km3=0.0)
    assert c["height"] == pytest.approx(100 + (10**4 * 500 + 10**6 * 3500) / (10**4 + 10**6))
    assert c["vil"] == pytest.approx(3.44e-6 * 1000 * ((10**4.0) ** (4 / 7) + (10**5.6) ** (4 / 7)))
    assert c["max_dbz"] == 60.0 and c["max_height"] == 3600.0 and (c["base"], c["echo_top"]) == (100.0, 4100.0)


def test_a_gap_of_one_column_is_bridged_but_holds_nothing(spark):
    [c] = cells(spark, [(0, r, a, 0, 40.0) for r in (9, 10, 11) for a in (3, 5)], least_km3=0.0)
    ring = lambda r: 5000 * (r + 0.5) * 5000 * 2 * math.pi / 36
    assert c["area_km2"] == pytest.approx(sum(3 * ring(r) for r in (9, 10, 11)) / 1e6)
    assert c["volume_km3"] == pytest.approx(sum(2 * ring(r) for r in (9, 10, 11)) * 1000 / 1e9)


def test_small_cells_go_the_largest_come_first_ties_by_place(spark):
    rows = [(0, 1, 1, 0, 40.0), (0, 10, 1, 0, 40.0), (0, 10, 20, 0, 40.0), (0, 15, 9, 0, 36.0), (1, 2, 2, 0, 34.9)]
    volume = lambda r: pytest.approx(5000 * (r + 0.5) * 5000 * 2 * math.pi / 36 * 1000 / 1e9)
    assert [(c["label"], c["max_dbz"], c["volume_km3"]) for c in cells(spark, rows, least_km3=40.0)] == [(1, 36.0, volume(15)), (2, 40.0, volume(10)), (3, 40.0, volume(10))]
    first = cells(spark, rows, least_km3=40.0, most=2)
    assert len(first) == 2 and first[1]["lon"] > 24.5  # sector 1 before sector 20
    assert cells(spark, [(1, 2, 2, 0, 34.9)]) == []


# ---------------------------------------------------------------- tracks

CELLS = "site int, scan int, at double, label int, lon double, lat double"


def follow(spark, rows):
    return {(t["site"], t["scan"], t["label"]): (t["track"], t["age"], t["u"], t["v"]) for t in cells3d.greedy_tracks(spark.createDataFrame(rows, CELLS), "site").collect()}


def test_a_track_is_sought_where_it_leads(spark):
    east = lambda m: m / (math.radians(1) * math.cos(math.radians(60)) * 6_371_000)
    rows = [(1, 0, 0.0, 1, 20.0, 60.0), (1, 1, 300.0, 1, 20.0 + east(9000), 60.0), (1, 2, 600.0, 1, 20.0 + east(9000), 60.0), (1, 2, 600.0, 2, 20.0 + east(18000), 60.0)]
    got = follow(spark, rows)
    assert got[1, 2, 2][:2] == ("0-1", 3) and got[1, 2, 1][:2] == ("2-1", 1) and got[1, 2, 1][2] is None
    assert got[1, 2, 2][2] == pytest.approx(30.0) and got[1, 2, 2][3] == pytest.approx(0.0)


def test_gates_gaps_and_the_antimeridian(spark):
    rows = [(1, 0, 0.0, 1, 20.0, 60.0), (1, 1, 300.0, 1, 20.0, 60.2), (1, 3, 900.0, 1, 20.0, 60.2), (2, 0, 0.0, 1, 179.98, 10.0), (2, 1, 300.0, 1, -179.98, 10.0), (2, 2, 300.0, 1, -179.98, 10.0), (2, 5, None, 1, 1.0, 1.0)]
    got = follow(spark, rows)
    assert got[1, 1, 1][:2] == ("1-1", 1)  # 22 km in 300 s
    assert got[1, 3, 1][:2] == ("3-1", 1)  # a scan without cells between
    assert got[2, 1, 1][:2] == ("0-1", 2) and got[2, 1, 1][2] == pytest.approx(4380 / 300, rel=1e-2)
    assert got[2, 2, 1][:2] == ("2-1", 1) and (2, 5, 1) not in got  # no time passed; no time at all


def test_tracks_equal_a_plain_loop_in_any_order(spark):
    rng = random.Random(3)
    rows = [(s, t, 300.0 * t, k + 1, 20 + rng.random() * 0.8, 60 + rng.random() * 0.4) for s in range(3) for t in range(14) for k in range(rng.randint(0, 6))]
    want, before, ran = {}, {}, {}
    for s in range(3):
        before = []
        for t in range(14):
            now = [list(r[3:]) for r in rows if r[:2] == (s, t)]
            cost = []
            for a, (label, lon, lat, track, age, motion) in enumerate(before):
                for b, (_, x, y) in enumerate(now):
                    e = math.radians(x - lon) * math.cos(math.radians((lat + y) / 2)) * 6_371_000
                    n = math.radians(y - lat) * 6_371_000
                    off = math.hypot(e - 300 * motion[0], n - 300 * motion[1])
                    if off <= 17000:
                        cost.append((off, a, b, e / 300, n / 300))
            ran = {}
            while cost:
                _, a, b, u, v = min(cost)
                ran[b] = (before[a][3], before[a][4] + 1, (u, v))
                cost = [c for c in cost if c[1] != a and c[2] != b]
            before = [(*c, *ran.get(b, (f"{t}-{c[0]}", 1, (0.0, 0.0)))) for b, c in enumerate(now)]
            want |= {(s, t, c[0]): (c[3], c[4]) for c in before}
    rng.shuffle(rows)
    got = follow(spark, rows)
    assert {k: v[:2] for k, v in got.items()} == want and max(v[1] for v in want.values()) > 2
    assert cells3d.greedy_tracks(spark.createDataFrame([], CELLS), "site").count() == 0
