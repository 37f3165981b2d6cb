"""Storm cells of radar volumes on cylindrical grids, and their tracks over the scans of a radar.

Voxels are first added up to columns; only columns go to the task that labels a scan, so that it holds no more than the grid has columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.functions import geo
from envspark.operators.nowcast import _union

#: The reflectivity above which hail is assumed, and the factor and power of liquid water (kg/m3 of mm6/m3).
HAIL_DBZ, WATER, WATER_POWER = 56.0, 3.44e-6, 4 / 7
#: Least reflectivity and volume of a cell, and how many cells a scan keeps.
CELL_DBZ, CELL_KM3, CELLS = 35.0, 5.0, 256
#: Fastest motion (m/s) and slack for the jitter of centroids (m).
MAX_SPEED_MS, BASE_GATE_M = 40.0, 5000.0


@dataclass(frozen=True)
class Grid:
    """n_r rings of dr metres from r0 on, n_a sectors over turn radians from a0 (clockwise from north), layers of dh metres from h0 on."""

    n_r: int
    n_a: int
    dr: float
    dh: float
    r0: float = 0.0
    a0: float = 0.0
    turn: float = 2 * math.pi
    h0: float = 0.0

    @property
    def da(self) -> float:
        return self.turn / self.n_a

    @property
    def wraps(self) -> bool:
        return abs(self.turn - 2 * math.pi) < 1e-9


def closed(wet: np.ndarray, wraps: bool) -> np.ndarray:
    """A mask (ring, sector) grown by one column all round and shrunk again; what lies off the grid neither grows nor shrinks it."""

    def around(mask: np.ndarray, outside: bool) -> list[np.ndarray]:
        m = np.pad(mask, ((1, 1), (0, 0)), constant_values=outside)
        m = np.pad(m, ((0, 0), (1, 1)), mode="wrap") if wraps else np.pad(m, ((0, 0), (1, 1)), constant_values=outside)
        return [m[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)]

    grown = np.logical_or.reduce(around(wet, False))
    return np.logical_and.reduce(around(grown, True))


def _parts(mask: np.ndarray, wraps: bool) -> tuple[np.ndarray, list[int]]:
    """Numbers of a mask's columns, row by row, and for each the least number of its 4-connected part."""
    n_a = mask.shape[1]
    number = np.arange(mask.size).reshape(mask.shape)
    pairs = [(number[mask], number[mask]), (number[:-1][mask[:-1] & mask[1:]], number[1:][mask[:-1] & mask[1:]]), (number[:, :-1][mask[:, :-1] & mask[:, 1:]], number[:, 1:][mask[:, :-1] & mask[:, 1:]])]
    if wraps and n_a > 1:
        seam = mask[:, 0] & mask[:, -1]
        pairs.append((number[:, 0][seam], number[:, -1][seam]))
    found = _union((int(a), int(b)) for x, y in pairs for a, b in zip(x, y))
    mine = number[mask]
    return mine, [found[int(p)] for p in mine]


def cell_columns(voxels: DataFrame, keys: list[str], grid: Grid, threshold: float = CELL_DBZ) -> DataFrame:
    """(keys, i_r, i_a, part, ...): the columns of each scan's cells; part is the number of the cell's first column, ring by ring.

    voxels: keys, i_r, i_a, i_h, dbz, one row each. A column belongs to the mask when one of its voxels reaches the threshold; the mask is
    closed by one column, and columns that only the closing adds have nulls. Null or NaN values and voxels off the grid take no part.
    """
    w, height = F.pow(F.lit(10.0), F.col("dbz") / 10), grid.h0 + (F.col("i_h") + 0.5) * grid.dh
    water = WATER * F.pow(F.pow(F.lit(10.0), F.least("dbz", F.lit(HAIL_DBZ)) / 10), F.lit(WATER_POWER)) * grid.dh
    on = (F.col("dbz") >= threshold) & ~F.isnan("dbz") & F.col("i_r").between(0, grid.n_r - 1) & F.col("i_a").between(0, grid.n_a - 1) & F.col("i_h").isNotNull()
    members = voxels.filter(on).select(*keys, F.col("i_r").cast("long").alias("i_r"), F.col("i_a").cast("long").alias("i_a"), F.col("i_h").cast("long").alias("i_h"), F.col("dbz").cast("double").alias("dbz"))
    columns = members.groupBy(*keys, "i_r", "i_a").agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * height).alias("wu"), F.max(F.struct("dbz", (-F.col("i_h")).alias("down"))).alias("top"), F.min("i_h").alias("low"), F.max("i_h").alias("high"), F.sum(water).alias("vil"))
    columns = columns.select(*keys, "i_r", "i_a", "n", "w", "wu", F.col("top.dbz").alias("dbz"), (-F.col("top.down")).alias("i_h"), "low", "high", "vil")

    def label(mine: pa.Table) -> pa.Table:
        r, a = mine.column("i_r").to_numpy(), mine.column("i_a").to_numpy()
        wet = np.zeros((grid.n_r, grid.n_a), bool)
        wet[r, a] = True
        numbers, parts = _parts(closed(wet, grid.wraps), grid.wraps)
        row = np.full(wet.size, -1)
        row[r * grid.n_a + a] = np.arange(len(r))
        at = row[numbers]  # the closing never takes a column away
        out = mine.take(pa.array(at, pa.int64(), mask=at < 0))
        own = {"i_r": pa.array(numbers // grid.n_a), "i_a": pa.array(numbers % grid.n_a)} | {k: mine.column(k).take(pa.array(np.zeros(len(numbers), np.int64))) for k in keys}
        return pa.table([own.get(c, out.column(c)) for c in mine.column_names] + [pa.array(parts, pa.int64())], names=[*mine.column_names, "part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema) + ", part long"
    return columns.groupBy(*keys).applyInArrow(label, schema)


def storm_cells(voxels: DataFrame, keys: list[str], grid: Grid, sites: DataFrame, on: list[str], threshold: float = CELL_DBZ, least_km3: float = CELL_KM3, most: int = CELLS) -> DataFrame:
    """Cells of each scan (keys), numbered by falling volume (ties: the first column), most of them at most.

    sites: on, lon, lat, height of the antenna. Of a cell: the largest value and its place, the centroid weighted by linear reflectivity,
    top and base over the sea, volume, area of the footprint, largest vertically integrated liquid, and the box around its voxels in metres
    east, north and above the antenna. A scan without a cell, or of a radar that sites doesn't hold, has no row.
    """
    r, angle = grid.r0 + (F.col("i_r") + 0.5) * grid.dr, grid.a0 + (F.col("i_a") + 0.5) * grid.da
    inner, outer = grid.r0 + F.col("i_r") * grid.dr, grid.r0 + (F.col("i_r") + 1) * grid.dr
    first, last = grid.a0 + F.col("i_a") * grid.da, grid.a0 + (F.col("i_a") + 1) * grid.da
    corners = lambda turn: [x * turn(y) for x in (inner, outer) for y in (first, last)]
    wet = lambda c: F.when(F.col("n").isNotNull(), c)
    order = F.struct("dbz", (-F.col("i_r")).alias("r"), (-F.col("i_a")).alias("a"), (-F.col("i_h")).alias("h"))
    # counts of whole numbers: a volume is the same in whatever order columns are added
    cells = cell_columns(voxels, keys, grid, threshold).groupBy(*keys, "part").agg(
        F.count("*").alias("columns"), F.sum(2 * F.col("i_r") + 1).alias("column_r"), F.sum("n").alias("n"), F.sum(F.col("n") * (2 * F.col("i_r") + 1)).alias("n_r"),
        F.sum("w").alias("w"), F.sum(F.col("w") * r * F.sin(angle)).alias("we"), F.sum(F.col("w") * r * F.cos(angle)).alias("wn"), F.sum("wu").alias("wu"), F.max(wet(order)).alias("top"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("vil").alias("vil"),
        F.min(wet(F.least(*corners(F.sin)))).alias("west"), F.max(wet(F.greatest(*corners(F.sin)))).alias("east"), F.min(wet(F.least(*corners(F.cos)))).alias("south"), F.max(wet(F.greatest(*corners(F.cos)))).alias("north"))
    size = lambda count, twice: grid.dr * grid.da * (grid.r0 * F.col(count) + grid.dr / 2 * F.col(twice))
    cells = cells.withColumn("volume_km3", size("n", "n_r") * grid.dh / 1e9).filter(F.col("volume_km3") >= least_km3)
    cells = cells.withColumn("label", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("volume_km3"), "part"))).filter(F.col("label") <= most).withColumn("label", F.col("label").cast("long"))
    placed = cells.join(sites.select(*on, F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.col("height").alias("up0")), on)
    e, n = F.col("we") / F.col("w"), F.col("wn") / F.col("w")
    lon, lat = geo.destination(F.col("lon0"), F.col("lat0"), F.degrees(F.atan2(e, n)), F.hypot(e, n))
    top_lon, top_lat = geo.destination(F.col("lon0"), F.col("lat0"), F.degrees(grid.a0 + (0.5 - F.col("top.a")) * grid.da), grid.r0 + (0.5 - F.col("top.r")) * grid.dr)
    layer = lambda i: grid.h0 + i * grid.dh
    return placed.select(
        *keys, "label", F.col("top.dbz").alias("max_dbz"), top_lon.alias("max_lon"), top_lat.alias("max_lat"), (F.col("up0") + layer(0.5 - F.col("top.h"))).alias("max_height"), lon.alias("lon"), lat.alias("lat"), (F.col("up0") + F.col("wu") / F.col("w")).alias("height"),
        (F.col("up0") + layer(F.col("high") + 1)).alias("echo_top"), (F.col("up0") + layer(F.col("low"))).alias("base"), "volume_km3", (size("columns", "column_r") / 1e6).alias("area_km2"), "vil", "west", "south", "east", "north", layer(F.col("low")).alias("bottom"), layer(F.col("high") + 1).alias("top"))


# ---------------------------------------------------------------- tracks


def _step(dx: float, lat: float, lat_: float) -> tuple[float, float]:
    """Metres east and north between two places dx degrees of longitude apart, the shorter way round."""
    dx = (dx + 180) % 360 - 180
    return math.radians(dx) * math.cos(math.radians((lat + lat_) / 2)) * geo.EARTH_M, math.radians(lat_ - lat) * geo.EARTH_M


def _follow(before: list[dict], after: list[dict]) -> None:
    """Gives the cells of a scan their tracks: nearest to where a track was heading first, each track and cell once."""
    span = after[0]["at"] - before[0]["at"] if before else 0.0
    pairs = []
    if span > 0:
        gate = MAX_SPEED_MS * span + BASE_GATE_M
        for i, a in enumerate(before):
            u, v = a["motion"] or (0.0, 0.0)
            for j, b in enumerate(after):
                e, n = _step(b["lon"] - a["lon"], a["lat"], b["lat"])
                off = math.hypot(e - u * span, n - v * span)
                if off <= gate:
                    pairs.append((off, i, j, e / span, n / span))
    taken: set[int] = set()
    for _, i, j, u, v in sorted(pairs):
        if i not in taken and "track" not in after[j]:
            taken.add(i)
            after[j] |= {"track": before[i]["track"], "age": before[i]["age"] + 1, "motion": (u, v)}
    for cell in after:
        if "track" not in cell:
            cell |= {"track": f"{cell['scan']}-{cell['label']}", "age": 1, "motion": None}


def greedy_tracks(cells: DataFrame, series: str) -> DataFrame:
    """(series, scan, label, track, age, u, v) of cells (series, scan, at, label, lon, lat): scan counts a radar's scans, at is in seconds.

    A track follows the cell nearest to where its last step leads, within 40 m/s and 5 km; ties go to the smaller labels. It ends with a scan
    in which it finds none, so that a scan without cells ends all: what lies between such scans is followed by itself. A task keeps two scans
    at a time. A track is named by its first scan and label; u and v (m/s) are its last step's, null before there is one.
    """
    known = cells.filter("scan is not null and at is not null and label is not null and lon is not null and lat is not null")
    seen = known.select(series, "scan").distinct()
    runs = seen.withColumn("run", F.col("scan") - F.row_number().over(W.partitionBy(series).orderBy("scan")))
    kind = cells.schema[series].dataType.simpleString()
    at = known.join(runs, [series, "scan"]).select(F.col(series).alias("series"), F.col("run").cast("long").alias("run"), F.col("scan").cast("long").alias("scan"), F.col("at").cast("double").alias("at"), F.col("label").cast("long").alias("label"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[dict] = []
        scan: list[dict] = []
        where = lambda c: (c["series"], c["run"], c["scan"])
        for batch in batches:
            done: list[dict] = []
            for cell in batch.to_pylist():
                if scan and where(scan[0]) != where(cell):
                    _follow(before if before and where(before[0])[:2] == where(scan[0])[:2] else [], scan)
                    done += scan
                    before, scan = scan, []
                scan.append(cell)
            yield _rows(done, batch.schema)
        if scan:
            _follow(before if before and where(before[0])[:2] == where(scan[0])[:2] else [], scan)
            yield _rows(scan, pa.schema([batch.schema.field("series")]))

    def _rows(done: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        names = ["series", "scan", "label", "track", "age", "u", "v"]
        kinds = [schema.field("series").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
        flat = [c | {"u": c["motion"] and c["motion"][0], "v": c["motion"] and c["motion"][1]} for c in done]
        return pa.RecordBatch.from_arrays([pa.array([c[n] for c in flat], k) for n, k in zip(names, kinds)], names=names)

    ordered = at.repartition("series", "run").sortWithinPartitions("series", "run", "scan", "label")
    return ordered.mapInArrow(fold, f"series {kind}, scan long, label long, track string, age long, u double, v double").withColumnRenamed("series", series)
