"""Polygons cut to tiles: what a tile shows is what the whole polygon has there."""

import math
import random

import pytest

from envspark.operators import tiles

RINGS = "id int, rings array<array<struct<x:double,y:double>>>"


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return odd


def turn(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def star(rng, x, y, size, n):
    spokes = [(size * rng.uniform(0.3, 1.0), 2 * math.pi * k / n) for k in range(n)]
    ring = [(x + r * math.cos(a), y + r / 2 * math.sin(a)) for r, a in spokes]
    return ring + ring[:1]


def test_points_of_every_tile_are_in_or_out_as_before(spark):
    rng, zoom = random.Random(5), 7
    shapes = []
    for k in range(12):
        x, y, size = rng.uniform(-175, 175), rng.uniform(-70, 70), rng.uniform(0.5, 7)
        rings = [star(rng, x, y, size, rng.randint(3, 14)), star(rng, x, y, size * 0.25, 5)]
        shapes.append((k, [r[:: rng.choice([1, -1])] for r in rings]))
    got = {}
    for r in tiles.tile_polygons(spark.createDataFrame(shapes, RINGS), ["id"], zoom).collect():
        got[r["id"], r["tile_x"], r["tile_y"]] = [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
    for rings in got.values():
        assert all(r[0] == r[-1] and len(r) > 3 for r in rings) and turn(rings[0]) >= 0 and all(turn(r) <= 0 for r in rings[1:])
        assert all(-256 <= round(v, 6) <= 4096 + 256 for r in rings for p in r for v in p)
    world = lambda lon, lat: ((lon / 360 + 0.5) * 128, (0.5 - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) / (2 * math.pi)) * 128)
    met = 0
    for k, rings in shapes:
        whole = [[world(*p) for p in r] for r in rings]
        xs, ys = [p[0] for p in whole[0]], [p[1] for p in whole[0]]
        for _ in range(300):
            u, v = rng.uniform(min(xs) - 0.1, max(xs) + 0.1), rng.uniform(min(ys) - 0.1, max(ys) + 0.1)
            for tx in range(max(0, math.ceil(u - 1.0625)), min(127, math.floor(u + 0.0625)) + 1):
                for ty in range(math.ceil(v - 1.0625), math.floor(v + 0.0625) + 1):
                    want = inside(u, v, whole)
                    assert inside((u - tx) * 4096, (v - ty) * 4096, got.get((k, tx, ty), [])) == want
                    met += want
    assert met > 300


def test_small_and_faulty_shapes(spark):
    square = [(10.0, 0.5), (10.5, 0.5), (10.5, 1.0), (10.0, 1.0), (10.0, 0.5)]
    rows = [(1, [square[:-1], [(10.1, 0.6), (10.2, 0.6)]]), (2, [[(1.0, 1.0), (None, 2.0), (2.0, 2.0)]]), (3, [[(1.0, 1.0), (math.nan, 2.0), (2.0, 2.0)]]), (4, []), (5, None), (6, [[]]), (7, [[], square]), (8, [[(1.0, 1.0), (1.0, 1.0)]]), (9, [[(0.0, 88.0), (1.0, 88.0), (1.0, 89.0)]])]
    found = tiles.tile_polygons(spark.createDataFrame(rows, RINGS), ["id"], 0).collect()
    assert sorted(r["id"] for r in found) == [1, 9] and len([r for r in found if r["id"] == 1][0]["rings"]) == 1
    assert all(p["y"] == pytest.approx(0.0, abs=1e-6) for r in found if r["id"] == 9 for p in r["rings"][0])  # held at the edge of the map
    assert tiles.tile_polygons(spark.createDataFrame([], RINGS), ["id"], 5).count() == 0


def test_points_near_a_border_are_in_both_tiles(spark):
    rows = [(1, 0.01, 10.0), (2, 0.0, 0.0), (3, 180.0, 10.0), (4, None, 1.0), (5, 1.0, math.nan), (6, 10.0, 30.0)]
    got = {}
    for r in tiles.tile_points(spark.createDataFrame(rows, "id int, lon double, lat double"), ["id"], 4).collect():
        got.setdefault(r["id"], {})[r["tile_x"], r["tile_y"]] = r["x"], r["y"]
    assert set(got[1]) == {(7, 7), (8, 7)} and set(got[2]) == {(7, 7), (8, 7), (7, 8), (8, 8)} and set(got[3]) == {(15, 7)} and len(got[6]) == 1
    assert got[2][8, 8] == (pytest.approx(0), pytest.approx(0)) and got[2][7, 7] == (pytest.approx(4096), pytest.approx(4096)) and not {4, 5} & set(got)
