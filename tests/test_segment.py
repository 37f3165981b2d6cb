"""Segmentation against a flood fill, with cells over many tiles."""

import random

import pytest

from envspark.operators import nowcast


def flood(wet, width):
    label = {}
    for p in sorted(wet, key=lambda p: p[0] * width + p[1]):
        if p not in label:
            stack = [p]
            label[p] = p[0] * width + p[1]
            while stack:
                r, c = stack.pop()
                for q in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if q in wet and q not in label:
                        label[q] = p[0] * width + p[1]
                        stack.append(q)
    return label


@pytest.mark.parametrize("tile", [3, 4, 256])
def test_cells_equal_a_flood_fill(spark, monkeypatch, tile):
    monkeypatch.setattr(nowcast, "TILE", tile)
    rng = random.Random(tile)
    rows = [(f, r, c, float(rng.randint(0, 9))) for f in range(4) for r in range(15) for c in range(17)]
    rows += [(9, r, 0, 9.0) for r in range(15)] + [(9, 14, 16, None)]
    got = {(r["frame"], r["row_idx"], r["col_idx"]): r["label"] for r in nowcast.segment(spark.createDataFrame(rows, "frame int, row_idx int, col_idx int, value double"), 6.0, 17).collect()}
    want = {}
    for f in {r[0] for r in rows}:
        want |= {(f, *p): v for p, v in flood({(r, c) for g, r, c, v in rows if g == f and v is not None and v >= 6.0}, 17).items()}
    assert got == want


def test_connected_groups(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in want:
                    want[x] = n
                    stack += near[x]
    got = nowcast.connected(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r["node"]: r["group"] for r in got} == want
    assert nowcast.connected(spark.createDataFrame([], "a long, b long")).count() == 0
