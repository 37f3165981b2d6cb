"""Storm cells matched and tracked over frames.

Cells that can be linked lie within a gate, so a grid of buckets as wide as the gate makes a sparse edge table; no pair outside
it is ever made. Groups connected by edges are independent of one another: each is assigned, or folded over its frames, by itself.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from envspark.operators.nowcast import _saved, connected

#: Gates (km, m/s) and the price of unlike cells (km an e-fold of area, km a dB of the maximum).
BASE_GATE_KM, MAX_SPEED_MS, RESIDUAL_SPEED_MS = 3.0, 35.0, 10.0
AREA_KM_PER_EFOLD, PEAK_KM_PER_DB = 2.0, 0.15
#: A mover that departs from the ambient flow, the shortest path with a direction, and the least straightness trusted.
DEVIANT_RESIDUAL_MS, DEVIANT_SPEED_MS, DEVIANT_STREAK = 5.0, 3.0, 2
LEAST_PATH_KM, LEAST_STRAIGHTNESS = 1.0, 0.5
#: Change of volume that counts (share and amount), and the steepest tendency of intensity (a second).
TREND_SHARE, TREND_AMOUNT, MAX_TENDENCY = 0.10, 1.0, 0.4 / 60
#: Severity steps (dBZ, km2) and the slack that a fall needs.
SEVERITY_DBZ, SEVERITY_KM2, SLACK_DBZ, SLACK_AREA = (45.0, 50.0, 55.0), 50.0, 2.0, 0.15
#: Fixed value: a strike outside every cell joins the nearest centre within this (km).
STRIKE_RADIUS_KM = 10.0


def _near(a: DataFrame, b: DataFrame, keys: list[str], gate: float, columns: list[str]) -> DataFrame:
    """Rows of a and b with equal keys whose (x, y) lie within gate; b's columns get a trailing underscore."""
    bucket = lambda c, d: (F.floor(F.col(c) / gate) + d).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.withColumn("_d", F.explode(around)).withColumns({"_bx": bucket("x", F.col("_d.i")), "_by": bucket("y", F.col("_d.j"))}).drop("_d")
    right = b.select(*keys, bucket("x", 0).alias("_bx"), bucket("y", 0).alias("_by"), *[F.col(c).alias(f"{c}_") for c in columns])
    met = left.join(right, [*keys, "_bx", "_by"]).drop("_bx", "_by").withColumn("distance", F.hypot(F.col("x") - F.col("x_"), F.col("y") - F.col("y_")))
    return met.filter(F.col("distance") <= gate)


def unlikeness(area: Column, area_: Column, most: Column, most_: Column) -> Column:
    """What a pair of cells costs beyond its distance."""
    least = F.lit(2.220446049250313e-16)
    return AREA_KM_PER_EFOLD * F.abs(F.ln(F.greatest(area_, least) / F.greatest(area, least))) + PEAK_KM_PER_DB * F.abs(most_ - most)


def cell_edges(before: DataFrame, after: DataFrame, gate: float, similar: bool = True) -> DataFrame:
    """(frame, was, label, distance, cost) of cells (frame, label, x, y, area_km2, most) of one frame number within gate of one another."""
    columns = ["label", "x", "y", "area_km2", "most"]
    met = _near(before.select("frame", *columns), after, ["frame"], gate, columns)
    cost = F.col("distance") + (unlikeness(F.col("area_km2"), F.col("area_km2_"), F.col("most"), F.col("most_")) if similar else F.lit(0.0))
    return met.select("frame", F.col("label").alias("was"), F.col("label_").alias("label"), "distance", cost.alias("cost"))


def assign(edges: list[tuple]) -> list[int]:
    """Of edges (a, b, cost) the places of those that link most nodes, each once, at the least cost of all such choices.

    Shortest augmenting paths: after each, the choice is the cheapest of its size.
    """
    out: dict = {}
    for e, (a, _, _) in enumerate(edges):
        out.setdefault(a, []).append(e)
    of_a: dict = {}
    of_b: dict = {}
    while True:
        far_a = {a: 0.0 for a in out if a not in of_a}
        far_b: dict = {}
        came: dict = {}
        queue = deque(far_a)
        while queue:
            a = queue.popleft()
            for e in out[a]:
                _, b, cost = edges[e]
                if of_a.get(a) != e and far_a[a] + cost < far_b.get(b, math.inf) - 1e-12:
                    far_b[b], came[b] = far_a[a] + cost, e
                    if b in of_b:
                        back = of_b[b]
                        over = edges[back][0]
                        if far_b[b] - edges[back][2] < far_a.get(over, math.inf) - 1e-12:
                            far_a[over] = far_b[b] - edges[back][2]
                            queue.append(over)
        free = [(far, b) for b, far in far_b.items() if b not in of_b]
        if not free:
            return sorted(of_a.values())
        b = min(free)[1]
        while True:
            e = came[b]
            a, left = edges[e][0], of_a.get(edges[e][0])
            of_a[a], of_b[b] = e, e
            if left is None:
                break
            b = edges[left][1]


def match_cells(before: DataFrame, after: DataFrame, gate: float, similar: bool = True) -> DataFrame:
    """(frame, was, label, distance, cost): cells of one frame number matched one to one, most pairs first, then the least cost.

    Each group of cells connected within the gate is solved exactly by itself. Frames or cells without a partner are absent.
    """
    edges = _saved(cell_edges(before, after, gate, similar))
    node = lambda side, c: F.concat_ws("/", F.lit(side), "frame", c)
    groups = connected(edges.select(node("a", "was").alias("a"), node("b", "label").alias("b")))

    def solve(mine: pa.Table) -> pa.Table:
        mine = mine.sort_by([("was", "ascending"), ("label", "ascending")])
        rows = list(zip(mine.column("was").to_pylist(), mine.column("label").to_pylist(), mine.column("cost").to_pylist()))
        return mine.take(pa.array(assign(rows), pa.int64())).drop_columns(["group"])

    grouped = edges.withColumn("node", node("a", "was")).join(groups, "node").drop("node")
    return grouped.groupBy("group").applyInArrow(solve, edges.schema)


def object_scores(forecast: DataFrame, observed: DataFrame, gate: float) -> DataFrame:
    """(frame, hits, misses, false_alarms, pod, far, csi, centroid_error) of forecast cells against the cells seen; without a denominator null."""
    matched = match_cells(forecast, observed, gate, similar=False).groupBy("frame").agg(F.count("*").alias("hits"), F.sum("distance").alias("off"))
    said, seen = forecast.groupBy("frame").agg(F.count("*").alias("said")), observed.groupBy("frame").agg(F.count("*").alias("seen"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = said.join(seen, "frame", "full").join(matched, "frame", "left").select("frame", n("hits").alias("hits"), (n("seen") - n("hits")).alias("misses"), (n("said") - n("hits")).alias("false_alarms"), "off")
    share = lambda c: F.try_divide(F.col("hits"), c)
    return both.select("frame", "hits", "misses", "false_alarms", share(F.col("hits") + F.col("misses")).alias("pod"), F.try_divide(F.col("false_alarms"), F.col("hits") + F.col("false_alarms")).alias("far"),
                       share(F.col("hits") + F.col("misses") + F.col("false_alarms")).alias("csi"), F.try_divide(F.col("off"), F.col("hits")).alias("centroid_error"))


def strikes_to_cells(strikes: DataFrame, pixels: DataFrame, cells: DataFrame, pixel_km: float, radius: float = STRIKE_RADIUS_KM) -> DataFrame:
    """(id, frame, label): the cell whose pixel a strike (id, frame, x, y in km) hits, else the nearest centre within radius (ties: the smaller label), else null.

    pixels: frame, row_idx, col_idx, label. cells: frame, label, x, y in km.
    """
    at = strikes.withColumns({"row_idx": F.floor(F.col("y") / pixel_km + 0.5).cast("int"), "col_idx": F.floor(F.col("x") / pixel_km + 0.5).cast("int")})
    hit = _saved(at.join(pixels.select("frame", F.col("row_idx").cast("int").alias("row_idx"), F.col("col_idx").cast("int").alias("col_idx"), "label"), ["frame", "row_idx", "col_idx"], "left").select("id", "frame", "x", "y", "label"))
    near = _near(hit.filter("label is null").drop("label"), cells, ["frame"], radius, ["label", "x", "y"]).groupBy("id").agg(F.min_by("label_", F.struct("distance", "label_")).alias("near"))
    return hit.join(near, "id", "left").select("id", "frame", F.coalesce("label", "near").alias("label"))


# ---------------------------------------------------------------- tracks


def severity(most: float, area: float, held: int | None = None) -> int:
    """0 to 3: a point for each step reached. A cell that was held at more keeps what it has but for a fall past the slack."""
    points = lambda dbz, share: min(3, sum(most >= s - dbz for s in SEVERITY_DBZ) + (area >= SEVERITY_KM2 * (1 - share)))
    now = points(0.0, 0.0)
    return now if held is None or now >= held else min(held, points(SLACK_DBZ, SLACK_AREA))


@dataclass(frozen=True)
class Track:
    """What the next frame needs of a track: its last cell and the state folded so far."""

    ident: str
    frame: int
    at: float
    cell: dict
    age: int = 1
    seconds: float = 0.0
    velocity: tuple[float, float] | None = None  # km a second
    first: tuple[float, float] = (0.0, 0.0)
    net: float = 0.0
    path: float = 0.0
    streak: int = 0
    severity: int = 0
    growing: bool | None = None
    anchor: float = 0.0
    tendency: float = 0.0
    step: str = "birth"

    @property
    def straightness(self) -> float | None:
        return min(1.0, self.net / self.path) if self.path > LEAST_PATH_KM else None


def born(cell: dict) -> Track:
    return Track(f"{cell['frame']}.{cell['label']}", cell["frame"], cell["at"], cell, first=(cell["x"], cell["y"]), severity=severity(cell["most"], cell["area_km2"]), anchor=cell["volume"])


def carried(track: Track, cell: dict, step: str) -> Track:
    """The track after a cell was matched to it."""
    was, span = track.cell, max(cell["at"] - track.at, 1.0)
    dx, dy = cell["x"] - was["x"], cell["y"] - was["y"]
    leg = math.hypot(dx, dy)
    scale = min(1.0, MAX_SPEED_MS / 1000 * span / leg) / span if leg else 0.0  # a jump is no motion: its size is cut, its direction stays
    vx, vy = dx * scale, dy * scale
    if track.velocity:
        vx, vy = (vx + track.velocity[0]) / 2, (vy + track.velocity[1]) / 2
    net = math.hypot(cell["x"] - track.first[0], cell["y"] - track.first[1])
    moved = replace(track, frame=cell["frame"], at=cell["at"], cell=cell, age=track.age + 1, seconds=track.seconds + span, velocity=(vx, vy), net=net, path=track.path + leg, step=step)
    apart = math.hypot(vx * 1000 - (cell["u"] or 0.0), vy * 1000 - (cell["v"] or 0.0))
    departs = apart > DEVIANT_RESIDUAL_MS and math.hypot(vx, vy) * 1000 > DEVIANT_SPEED_MS and (moved.straightness or 0.0) >= LEAST_STRAIGHTNESS
    change = cell["volume"] - track.anchor
    told = abs(change) > TREND_SHARE * max(abs(track.anchor), 1e-7) and abs(change) > TREND_AMOUNT
    mean = lambda c: c["volume"] / max(c["pixels"], 1)
    steep = max(-MAX_TENDENCY, min(MAX_TENDENCY, (mean(cell) - mean(was)) / span))
    return replace(
        moved, streak=track.streak + 1 if departs else 0, severity=severity(cell["most"], cell["area_km2"], track.severity),
        growing=change > 0 if told else track.growing, anchor=cell["volume"] if told else track.anchor, tendency=(steep + track.tendency) / 2,
    )


def _pairs(places: list[tuple[float, float]], tracks: list[Track], cells: list[dict], gate: float) -> list[tuple[int, int]]:
    edges = []
    for i, ((x, y), t) in enumerate(zip(places, tracks)):
        for j, c in enumerate(cells):
            far = math.hypot(c["x"] - x, c["y"] - y)
            if far <= gate:
                size = abs(math.log(max(c["area_km2"], 2.220446049250313e-16) / max(t.cell["area_km2"], 2.220446049250313e-16)))
                edges.append((i, j, far + AREA_KM_PER_EFOLD * size + PEAK_KM_PER_DB * abs(c["most"] - t.cell["most"])))
    return [edges[e][:2] for e in assign(edges)]


def advance(tracks: list[Track], cells: list[dict], kinds: tuple[str, str]) -> dict[int, Track]:
    """Cells by place with the tracks that they carry on: near where the motion takes a track, then, of what is left, near where it was."""
    out: dict[int, Track] = {}
    if not tracks or not cells:
        return out
    span = max(cells[0]["at"] - tracks[0].at, 1.0)
    ahead = [(t.cell["x"] + v[0] * span, t.cell["y"] + v[1] * span) for t in tracks for v in [t.velocity or ((t.cell["u"] or 0.0) / 1000, (t.cell["v"] or 0.0) / 1000)]]
    taken = set()
    for i, j in _pairs(ahead, tracks, cells, BASE_GATE_KM + RESIDUAL_SPEED_MS * span / 1000):
        out[j] = carried(tracks[i], cells[j], kinds[0])
        taken.add(i)
    left, free = [t for i, t in enumerate(tracks) if i not in taken], [j for j in range(len(cells)) if j not in out]
    for i, j in _pairs([(t.cell["x"], t.cell["y"]) for t in left], left, [cells[j] for j in free], BASE_GATE_KM + MAX_SPEED_MS * span / 1000):
        out[free[j]] = carried(left[i], cells[free[j]], kinds[1])
    return out


def fold(cells: list[dict]) -> list[Track]:
    """All cells of a system with their tracks' state: tracks of the frame before first, then those last seen two frames ago, then births."""
    out: list[Track] = []
    previous: list[Track] = []
    missing: list[Track] = []
    by_frame: dict[int, list[dict]] = {}
    for c in sorted(cells, key=lambda c: (c["frame"], c["label"])):
        by_frame.setdefault(c["frame"], []).append(c)
    last = None
    for frame, own in by_frame.items():
        if last is not None and frame - last > 1:  # frames between had none of these cells
            previous, missing = ([], previous) if frame - last == 2 else ([], [])
        found = advance(previous, own, ("first", "second"))
        rest = [j for j in range(len(own)) if j not in found]
        again = advance(missing, [own[j] for j in rest], ("coast", "coast"))
        found |= {rest[j]: t for j, t in again.items()}
        now = [found.get(j) or born(c) for j, c in enumerate(own)]
        seen = {t.ident for t in now}
        previous, missing, last = now, [t for t in previous if t.ident not in seen], frame
        out += now
    return out


TRACKED = "frame int, label long, track string, age int, step string, seconds double, u double, v double, net_km double, path_km double, straightness double, deviant boolean, severity int, growing boolean, anchor double, tendency double"


def track(cells: DataFrame) -> DataFrame:
    """The cells with their tracks (see TRACKED) and the columns of series.

    cells: series, frame (the number of its generation: consecutive), at (its time in seconds), label, x, y (km, y to the south), area_km2,
    pixels, most, volume, u, v (ambient motion in m/s, null: none). A track's name is its first cell's frame and label. A track may
    miss one frame. Systems, which no track can leave or enter, are groups of cells connected within the widest gate over one or two
    frames; each is folded by itself, in the order of its frames.
    """
    own = cells.select("series", F.col("frame").cast("int").alias("frame"), F.col("at").cast("double").alias("at"), F.col("label").cast("long").alias("label"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "area_km2", "pixels", "most", "volume", "u", "v")])
    own = _saved(own.withColumn("node", F.concat_ws("/", "series", "frame", "label")))
    ledger = own.select("series", "frame", "at").distinct()  # a row a frame
    lag = F.col("at") - F.lag("at", 2).over(W.partitionBy("series").orderBy("frame"))
    lag_one = F.col("at") - F.lag("at").over(W.partitionBy("series").orderBy("frame"))
    spans = ledger.select(F.greatest(lag, lag_one).alias("span")).agg(F.max("span")).first()[0] or 1.0
    wind = own.agg(F.max(F.hypot("u", "v"))).first()[0] or 0.0
    reach = lambda s: BASE_GATE_KM + (max(MAX_SPEED_MS, wind) + RESIDUAL_SPEED_MS) * s / 1000
    ahead = own.withColumn("_s", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("frame", F.col("frame") + F.col("_s"))
    met = _near(ahead.select("series", "frame", "node", "at", "x", "y"), own, ["series", "frame"], reach(max(spans, 1.0)), ["node", "at", "x", "y"])
    met = met.filter(F.col("distance") <= reach(1.0) + (reach(1.0) - reach(0.0)) * F.greatest(F.col("at_") - F.col("at") - 1, F.lit(0.0)))
    systems = connected(met.select(F.col("node").alias("a"), F.col("node_").alias("b")))
    grouped = own.join(systems, "node", "left").withColumn("system", F.coalesce("group", "node")).drop("group", "node")

    def run(mine: pa.Table) -> pa.Table:
        rows = mine.to_pylist()
        out = fold(rows)
        speed = lambda t, i: t.velocity[i] * 1000 if t.velocity else None
        values = [(rows[0]["series"], t.frame, t.cell["label"], t.ident, t.age, t.step, t.seconds, speed(t, 0), speed(t, 1), t.net, t.path, t.straightness, t.streak >= DEVIANT_STREAK, t.severity, t.growing, t.anchor, t.tendency) for t in out]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*values), schema)], schema=schema)

    kind = cells.schema["series"].dataType
    basic = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([("series", to_arrow_type(kind))] + [(n, basic[t]) for n, t in (x.split() for x in TRACKED.split(", "))])
    return grouped.groupBy("system").applyInArrow(run, f"series {kind.simpleString()}, {TRACKED}")
