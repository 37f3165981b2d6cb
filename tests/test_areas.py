"""Grids of areas by hand."""

import pytest

from envspark.operators import areas

RINGS = "area_id int, rings array<array<struct<x:double,y:double>>>"


def cells(spark, shapes, dx, dy, most=None):
    out = {}
    for r in areas.area_cells(spark.createDataFrame(shapes, RINGS), dx, dy, most).collect():
        out.setdefault(r["area_id"], {})[r["ix"], r["iy"]] = (round(r["lon"], 6), round(r["lat"], 6), r["inside"], r["coarsened"])
    return out


def test_masks_rectangles_slivers_and_the_seam(spark):
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    got = cells(spark, [
        (1, [box(0.0, 0.0, 2.5, 1.0)]), (2, [box(0.0, 0.0, 3.0, 3.0), box(0.9, 0.9, 2.1, 2.1)]), (3, [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]),
        (4, [[(0.0, 0.0), (3.0, 0.0), (3.0, 0.1), (2.9, 0.01), (0.0, 0.01), (0.0, 0.0)]]), (5, [box(179.0, 0.0, 181.0, 1.0)]), (6, [box(1.0, 1.0, 1.0, 1.0)]), (7, []), (8, [[]])], 1.0, 1.0)
    assert len(got[1]) == 3 and all(c[2] and not c[3] for c in got[1].values()) and got[1][0, 0][:2] == (pytest.approx(2.5 / 6), 0.5)
    assert [k for k, c in got[2].items() if not c[2]] == [(1, 1)] and got[2][0, 0][:2] == (0.5, 2.5)
    assert {k for k, c in got[3].items() if c[2]} == {(x, y) for x in range(4) for y in range(4) if (x + 0.5) + (4 - y - 0.5) <= 4}
    assert {k for k, c in got[4].items() if c[2]} == {(0, 0), (2, 0)}  # no centre: the vertices' cells
    assert [got[5][i, 0][0] for i in (0, 1)] == [179.5, -179.5] and len(got[6]) == 1 and not {7, 8} & set(got)


@pytest.mark.parametrize("wide, high, most, shape", [(7, 6, 42, (7, 6)), (7, 6, 30, (5, 6)), (100, 1, 10, (10, 1)), (1, 100, 10, (1, 10)), (9, 9, 1, (1, 1)), (8, 8, 16, (4, 4))])
def test_coarser_grids_fit(spark, wide, high, most, shape):
    ring = [(0.0, 0.0), (float(wide), 0.0), (float(wide), float(high)), (0.0, float(high)), (0.0, 0.0)]
    got = cells(spark, [(1, [ring])], 1.0, 1.0, most)[1]
    assert set(got) == {(x, y) for x in range(shape[0]) for y in range(shape[1])} and {c[3] for c in got.values()} == {shape != (wide, high)}
