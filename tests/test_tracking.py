"""Matching against all assignments, tracks against a plain loop over whole frames and against scenes by hand."""

import itertools
import math
import random

import pytest

from envspark.operators import tracking as T


def best(edges):
    """Size and cost of the best assignment, by trying all."""
    costs = {(a, b): c for a, b, c in edges}
    left, right = sorted({a for a, _, _ in edges}), sorted({b for _, b, _ in edges})
    found = (0, 0.0)
    for own in itertools.product([None, *right], repeat=len(left)):
        used = [b for b in own if b is not None]
        if len(set(used)) == len(used) and all(b is None or (a, b) in costs for a, b in zip(left, own)):
            found = min(found, (-len(used), sum(costs[a, b] for a, b in zip(left, own) if b is not None)))
    return -found[0], found[1]


def test_assignment_is_the_best_of_all():
    for seed in range(150):
        rng = random.Random(seed)
        pairs = rng.sample([(a, b) for a in range(5) for b in range(5)], rng.randint(0, 14))
        edges = [(a, b, rng.choice([rng.uniform(0, 9), float(rng.randint(0, 3))])) for a, b in pairs]
        chosen = [edges[e] for e in T.assign(edges)]
        assert len({a for a, _, _ in chosen}) == len({b for _, b, _ in chosen}) == len(chosen)
        size, cost = best(edges)
        assert len(chosen) == size and math.isclose(sum(c for _, _, c in chosen), cost, abs_tol=1e-9)


def scene(seed, frames=9, n=6, size=60.0):
    """Cells that move, jump, fade out and come back."""
    rng = random.Random(seed)
    cells, storms = [], [[rng.uniform(0, size), rng.uniform(0, size), rng.uniform(-3, 3), rng.uniform(-3, 3)] for _ in range(n)]
    for f in range(frames):
        for k, s in enumerate(storms):
            s[0], s[1] = s[0] + s[2] + rng.gauss(0, 0.7), s[1] + s[3] + rng.gauss(0, 0.7)
            if rng.random() < 0.85 and f != 6:
                pixels = rng.randint(3, 40)
                cells.append(dict(series="a", frame=f, at=f * 300.0, label=k, x=s[0], y=s[1], area_km2=pixels * 1.5, pixels=float(pixels), most=rng.uniform(36, 58), volume=pixels * rng.uniform(1, 9), u=rng.choice([None, 5.0]), v=2.0))
    return cells


def plain_ids(cells):
    """Frame by frame over all cells, the best assignment found by trying all."""
    def solve(tracks, own, places, gate):
        edges = [(i, j, d + 2.0 * abs(math.log(c["area_km2"] / t["cell"]["area_km2"])) + 0.15 * abs(c["most"] - t["cell"]["most"]))
                 for i, t in enumerate(tracks) for j, c in enumerate(own) for d in [math.hypot(c["x"] - places[i][0], c["y"] - places[i][1])] if d <= gate]
        costs, goal = {(a, b): c for a, b, c in edges}, best(edges)
        left = sorted({a for a, _, _ in edges})
        for pick in itertools.product([None, *sorted({b for _, b, _ in edges})], repeat=len(left)):
            pairs = [(a, b) for a, b in zip(left, pick) if b is not None]
            if len(pairs) == goal[0] and len({b for _, b in pairs}) == goal[0] and all(p in costs for p in pairs) and math.isclose(sum(costs[p] for p in pairs), goal[1], abs_tol=1e-9):
                return pairs
        return []

    def step(tracks, own):
        got = {}
        if tracks and own:
            ds = own[0]["at"] - tracks[0]["cell"]["at"]
            ahead = [(t["cell"]["x"] + (t["v"] or (t["cell"]["u"] or 0, t["cell"]["v"] or 0))[0] * ds / 1000, t["cell"]["y"] + (t["v"] or (t["cell"]["u"] or 0, t["cell"]["v"] or 0))[1] * ds / 1000) for t in tracks]
            for i, j in solve(tracks, own, ahead, 3 + 10 * ds / 1000):
                got[j] = tracks[i]
            used = [id(t) for t in got.values()]
            left, free = [t for t in tracks if id(t) not in used], [j for j in range(len(own)) if j not in got]
            for i, j in solve(left, [own[j] for j in free], [(t["cell"]["x"], t["cell"]["y"]) for t in left], 3 + 35 * ds / 1000):
                got[free[j]] = left[i]
            for j, t in list(got.items()):
                vx, vy = ((own[j][k] - t["cell"][k]) / ds * 1000 for k in "xy")
                fast = max(1.0, math.hypot(vx, vy) / 35)
                vx, vy = vx / fast, vy / fast
                if t["v"]:
                    vx, vy = (vx + t["v"][0]) / 2, (vy + t["v"][1]) / 2
                got[j] = dict(id=t["id"], cell=own[j], v=(vx, vy), age=t["age"] + 1)
        return got

    out, previous, missing = {}, [], []
    for f in range(max(c["frame"] for c in cells) + 1):
        own = [c for c in cells if c["frame"] == f]
        got = step(previous, own)
        rest = [j for j in range(len(own)) if j not in got]
        got |= {rest[j]: t for j, t in step(missing, [own[j] for j in rest]).items()}
        now = [got.get(j) or dict(id=f"{f}.{c['label']}", cell=c, v=None, age=1) for j, c in enumerate(own)]
        ids = {t["id"] for t in now}
        previous, missing = now, [t for t in previous if t["id"] not in ids]
        out |= {(f, c["label"]): (t["id"], t["age"]) for c, t in zip(own, now)}
    return out


def df(spark, cells):
    return spark.createDataFrame(cells, "series string, frame int, at double, label int, x double, y double, area_km2 double, pixels double, most double, volume double, u double, v double")


def test_tracks_equal_the_plain_loop(spark):
    cells = []
    for seed in range(5):  # five series, each of it a scene of its own
        cells += [c | {"series": str(seed)} for c in scene(seed)]
    got = {(r["series"], r["frame"], r["label"]): (r["track"], r["age"]) for r in T.track(df(spark, cells)).collect()}
    want = {(str(s), *k): v for s in range(5) for k, v in plain_ids(scene(s)).items()}
    assert got == want
    assert len({t for t, _ in got.values()}) < len(got) / 2


def cell(frame, label, x, y=0.0, pixels=10.0, most=45.0, volume=50.0, u=None, v=None):
    return dict(series="a", frame=frame, at=frame * 300.0, label=label, x=float(x), y=float(y), area_km2=pixels * 1.0, pixels=pixels, most=most, volume=volume, u=u, v=v)


def test_split_merge_and_gaps(spark):
    cells = [cell(0, 1, 0), cell(1, 1, 2), cell(2, 1, 4), cell(2, 2, 6, pixels=3.0)]  # splits: the larger part carries the track on
    cells += [cell(3, 1, 6.5, pixels=12.0)]  # merges again: one track is missing, and back two frames later
    cells += [cell(4, 1, 8), cell(4, 2, 10, pixels=3.0)]
    cells += [cell(f, 9, 500) for f in (0, 1, 3, 4, 7)]  # missing once, then twice
    got = {(r["frame"], r["label"]): r for r in T.track(df(spark, cells)).collect()}
    assert [got[f, 1]["track"] for f in range(5)] == ["0.1"] * 5
    assert got[2, 2]["track"] == got[4, 2]["track"] == "2.2" and got[4, 2]["step"] == "coast" and got[4, 2]["seconds"] == 600
    assert [got[f, 9]["track"] for f in (0, 1, 3, 4, 7)] == ["0.9"] * 4 + ["7.9"]
    assert got[3, 9]["age"] == 3 and got[3, 9]["seconds"] == 900


def test_state_of_a_track(spark):
    rows = [(0, 0, 44.0, 100.0), (1, 3, 50.5, 104.0), (2, 6, 49.0, 109.0), (3, 9, 44.0, 111.0), (4, 12, 40.0, 98.0), (5, 40, 40.0, 98.0)]
    got = {r["frame"]: r for r in T.track(df(spark, [cell(f, 1, x, volume=v, most=m, u=0.0, v=8.0) for f, x, m, v in rows])).collect()}
    assert [got[f]["severity"] for f in range(5)] == [0, 2, 2, 1, 0]
    assert [got[f]["growing"] for f in range(5)] == [None, None, None, True, False]  # the anchor stays until the change from it counts
    assert [got[f]["anchor"] for f in range(5)] == [100, 100, 100, 111, 98]
    assert got[1]["u"] == pytest.approx(10.0) and got[4]["path_km"] == pytest.approx(12) and got[4]["straightness"] == pytest.approx(1)
    assert [got[f]["deviant"] for f in range(5)] == [False, False, True, True, True]
    assert got[2]["tendency"] == pytest.approx((0.5 / 300 + (0.4 / 300) / 2) / 2)
    assert got[5]["track"] == "5.1"  # 28 km in 300 s is no motion of a cell


def test_matching_groups_and_scores(spark):
    rng = random.Random(3)
    make = lambda k: [(f, i, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(2, 90), rng.uniform(35, 60)) for f in range(3) for i in range(k)]
    schema = "frame int, label int, x double, y double, area_km2 double, most double"
    a, b = make(6), make(5)
    got = T.match_cells(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 14.0).collect()
    for f in range(3):
        edges = []
        for _, i, x, y, area, most in (r for r in a if r[0] == f):
            for _, j, x2, y2, area2, most2 in (r for r in b if r[0] == f):
                if math.hypot(x - x2, y - y2) <= 14:
                    edges.append((i, j, math.hypot(x - x2, y - y2) + 2 * abs(math.log(area2 / area)) + 0.15 * abs(most - most2)))
        own = [r for r in got if r["frame"] == f]
        size, cost = best(edges)
        assert len(own) == size and sum(r["cost"] for r in own) == pytest.approx(cost)
    scores = {r["frame"]: r for r in T.object_scores(spark.createDataFrame(a + [(7, 0, 1.0, 1.0, 1.0, 40.0)], schema), spark.createDataFrame(b + [(8, 0, 1.0, 1.0, 1.0, 40.0)], schema), 14.0).collect()}
    assert all(scores[f]["hits"] + scores[f]["misses"] == 5 and scores[f]["hits"] + scores[f]["false_alarms"] == 6 for f in range(3))
    assert (scores[7]["far"], scores[7]["pod"], scores[8]["pod"], scores[8]["centroid_error"]) == (1.0, None, 0.0, None)


def test_strikes_meet_pixels_then_centres(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 5), (0, 9, 9, 99)], "frame int, row_idx int, col_idx int, label int")
    cells = spark.createDataFrame([(0, 5, 1.0, 0.0), (0, 99, 18.0, 18.0)], "frame int, label int, x double, y double")
    strikes = spark.createDataFrame([(1, 0, 2.4, 0.9), (2, 0, 9.0, 9.0), (3, 0, 8.0, 0.0), (4, 0, 28.1, 18.0), (5, 1, 0.0, 0.0)], "id int, frame int, x double, y double")
    got = {r["id"]: r["label"] for r in T.strikes_to_cells(strikes, pixels, cells, 2.0).collect()}
    assert got == {1: 5, 2: None, 3: 5, 4: None, 5: None}


def test_empty_tables(spark):
    assert T.track(df(spark, [])).count() == 0
    none = spark.createDataFrame([], "frame int, label int, x double, y double, area_km2 double, most double")
    assert T.match_cells(none, none, 10.0).count() == 0
