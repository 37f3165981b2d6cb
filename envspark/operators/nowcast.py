"""Radar frames: segmentation into cells and their statistics."""

from __future__ import annotations

import itertools
import math
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def _saved(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that the cluster names in spark.checkpoint.dir; a folder of this machine's own only if all runs on it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _union(pairs: Iterable[tuple]) -> dict:
    """Each node of the pairs and the least node that it is connected to."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def connected(edges: DataFrame) -> DataFrame:
    """(node, group) of edges (a, b): the smallest node that a node is connected to.

    Each task first shrinks its edges to stars around the least node it knows. Over the stars nodes take their neighbours' least
    label, then that label's own, until nothing moves.
    """
    kind, arrow = edges.schema["a"].dataType.simpleString(), to_arrow_type(edges.schema["a"].dataType)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        for batch in itertools.chain(batches, [None]):
            if own and (batch is None or len(own) > 500_000):
                found = _union(own)
                yield pa.RecordBatch.from_arrays([pa.array(x, arrow) for x in (list(found), list(found.values()))], names=["a", "b"])
                own = []
            if batch is not None:
                own += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())

    stars = edges.select("a", "b").mapInArrow(shrink, f"a {kind}, b {kind}")
    both = _saved(stars.union(stars.select("b", "a")).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("group"))
    while True:
        label = _saved(label)
        near = both.join(label.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        via = label.join(near, "node").select("node", F.col("group").alias("old"), F.least("group", "near").alias("via"))
        after = _saved(via.join(label.select(F.col("node").alias("via"), F.col("group").alias("up")), "via").select("node", "old", F.least("via", "up").alias("group")))
        label = after.select("node", "group")
        if not after.filter("old <> group").limit(1).count():
            return label


#: Frames are cut into tiles of so many rows and columns.
TILE = 256


def segment(frames: DataFrame, threshold: float, width: int) -> DataFrame:
    """(frame, row_idx, col_idx, value, label): 8-connected cells of value >= threshold; label is the cell's smallest pixel number.

    Tiles are labelled each by itself; where cells touch over the edge of a tile, their labels are joined. Other columns are left out; a cell
    of the grid must have one value.
    """

    def tile(mine: pa.Table) -> pa.Table:
        pixels = mine.column("pixel").to_pylist()
        own = set(pixels)
        col = [(p, p % width) for p in pixels]
        pairs = [(p, p) for p in pixels] + [(p, q) for p, c in col for q, d in ((p - 1, c - 1), (p - width - 1, c - 1), (p - width, c), (p - width + 1, c + 1)) if 0 <= d < width and q in own]
        found = _union(pairs)
        return mine.append_column("part", pa.array([found[p] for p in pixels], pa.int64()))

    wet = frames.filter(F.col("value") >= threshold).select("frame", "row_idx", "col_idx", "value", (F.col("row_idx").cast("long") * width + F.col("col_idx")).alias("pixel"))
    wet = wet.withColumns({"tile_r": F.floor(F.col("row_idx") / TILE), "tile_c": F.floor(F.col("col_idx") / TILE)})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wet.schema) + ", part long"
    parts = _saved(wet.groupBy("frame", "tile_r", "tile_c").applyInArrow(tile, schema))
    at_edge = lambda c: F.pmod(F.col(c), F.lit(TILE)).isin(0, TILE - 1)
    edge = parts.filter(at_edge("row_idx") | at_edge("col_idx")).select("frame", "row_idx", "col_idx", "tile_r", "tile_c", "part")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = edge.withColumn("d", F.explode(steps)).select("frame", (F.col("row_idx") + F.col("d.r")).alias("row_idx"), (F.col("col_idx") + F.col("d.c")).alias("col_idx"), F.col("part").alias("other"), F.col("tile_r").alias("r"), F.col("tile_c").alias("c"))
    touch = ahead.join(edge, ["frame", "row_idx", "col_idx"]).filter("r <> tile_r or c <> tile_c").select("frame", "other", "part").distinct()
    label = F.col("part")
    touch = _saved(touch)
    if touch.limit(1).count():
        node = lambda c: F.struct(F.col("frame"), F.col(c).alias("part"))
        groups = connected(touch.select(F.to_json(node("other")).alias("a"), F.to_json(node("part")).alias("b")))
        named = groups.select(F.from_json("node", touch.select(node("part").alias("n")).schema["n"].dataType.simpleString()).alias("n"), "group")
        least = named.groupBy("group").agg(F.min("n.part").alias("least")).join(named, "group").select("n.frame", "n.part", "least")
        parts, label = parts.join(least, ["frame", "part"], "left"), F.coalesce("least", "part")
    return parts.select("frame", "row_idx", "col_idx", "value", label.alias("label"))


def cell_stats(cells: DataFrame, threshold: float, least_pixels: int = 1) -> DataFrame:
    """Per cell: pixels, maximum, exceedance sum and exceedance-weighted centroid."""
    over = F.col("value") - threshold
    s = cells.groupBy("frame", "label").agg(
        F.count("*").alias("pixels"), F.max("value").alias("most"), F.sum(over).alias("volume"), F.sum(over * F.col("row_idx")).alias("r"), F.sum(over * F.col("col_idx")).alias("c"), F.avg("row_idx").alias("mr"), F.avg("col_idx").alias("mc")
    ).filter(F.col("pixels") >= least_pixels)
    return s.select("frame", "label", "pixels", "most", "volume", F.coalesce(F.try_divide("r", "volume"), "mr").alias("centre_row"), F.coalesce(F.try_divide("c", "volume"), "mc").alias("centre_col"))


def motion(frames: DataFrame, block: int, reach: int, echo: float) -> DataFrame:
    """(frame, block_row, block_col, d_row, d_col): how far the echo of each block moves until the next frame, in cells.

    Of all displacements up to reach the one with the least mean absolute difference, plus 1e-4 a cell of distance, refined
    by a parabola through its neighbours by at most half a cell. A block needs an echo in 2 % of its cells, and a displacement
    must compare half of them. Cells without a value take no part.
    """
    key = ["frame", "block_row", "block_col"]
    at = frames.filter("value is not null").withColumns({"block_row": F.floor(F.col("row_idx") / block), "block_col": F.floor(F.col("col_idx") / block)})
    wet = at.groupBy(key).agg(F.count("*").alias("cells"), F.avg((F.col("value") >= echo).cast("double")).alias("share")).filter("share >= 0.02")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)])
    moved = at.join(wet, key).withColumn("d", F.explode(steps))
    moved = moved.select(*key, "cells", "value", F.col("d.r").alias("r"), F.col("d.c").alias("c"), (F.col("frame") + 1).alias("next"), (F.col("row_idx") + F.col("d.r")).alias("to_row"), (F.col("col_idx") + F.col("d.c")).alias("to_col"))
    after = frames.filter("value is not null").select(F.col("frame").alias("next"), F.col("row_idx").alias("to_row"), F.col("col_idx").alias("to_col"), F.col("value").alias("later"))
    cost = moved.join(after, ["next", "to_row", "to_col"]).groupBy(*key, "r", "c").agg(F.avg(F.abs(F.col("value") - F.col("later"))).alias("mean"), F.count("*").alias("n"), F.first("cells").alias("cells"))
    cost = cost.filter("2 * n >= cells").select(*key, "r", "c", F.round(F.col("mean") + 1e-4 * F.sqrt(F.col("r") * F.col("r") + F.col("c") * F.col("c")), 9).alias("cost"))
    # every block has (2 reach + 1)^2 costs at most
    costs = cost.groupBy(key).agg(F.min(F.struct("cost", "r", "c")).alias("best"), F.map_from_entries(F.collect_list(F.struct(F.struct("r", "c"), "cost"))).alias("all"))

    def fitted(axis: str):
        near = [F.col("all")[F.struct((F.col("best.r") + (s if axis == "r" else 0)).alias("r"), (F.col("best.c") + (s if axis == "c" else 0)).alias("c"))] for s in (-1, 1)]
        bend = near[0] - 2 * F.col("best.cost") + near[1]
        shift = F.when(bend > 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (near[0] - near[1]) / (2 * bend))))
        return F.col(f"best.{axis}") + F.coalesce(shift, F.lit(0.0))

    return costs.select(*key, fitted("r").alias("d_row"), fitted("c").alias("d_col"))


def filter_motion(vectors: DataFrame, rows: int, columns: int, neighbours: int = 30, sigmas: float = 3.0, passes: int = 2) -> DataFrame:
    """A motion for every block of each frame that has any: (frame, block_row, block_col, d_row, d_col, measured).

    vectors: frame, block_row, block_col, d_row, d_col of measured blocks. A vector goes that lies over sigmas * 1.4826 * MAD, and over 2 cells, from
    the (upper) median of its nearest measured blocks (ties: the smaller block number) in either component; frames of under 4 blocks
    keep all. Other blocks are filled from the known ones of the 3 x 3 around them, ring by ring, and then smoothed by passes of the 3 x 3
    mean. A frame's blocks, a thousandth of its cells, are one group.
    """

    def run(mine: pa.Table) -> pa.Table:
        at = mine.column("block_row").to_numpy() * columns + mine.column("block_col").to_numpy()
        order = np.argsort(at)
        at, uv = at[order], np.stack([mine.column(c).to_numpy()[order] for c in ("d_row", "d_col")], axis=1)
        keep = np.ones(len(at), dtype=bool)
        if len(at) >= 4:
            k, place = max(1, min(neighbours, len(at) - 1)), np.stack(np.divmod(at, columns), axis=1)
            for i in range(len(at)):
                far = ((place - place[i]) ** 2).sum(axis=1)
                far[i] = np.iinfo(np.int64).max
                near = uv[np.lexsort((at, far))[:k]]
                middle = np.sort(near, axis=0)[k // 2]
                mad = np.sort(np.abs(near - middle), axis=0)[k // 2]
                keep[i] = (np.abs(uv[i] - middle) <= np.maximum(sigmas * 1.4826 * mad, 2.0)).all()
        field, known = np.zeros((rows * columns, 2)), np.zeros(rows * columns, dtype=bool)
        field[at[keep]], known[at[keep]] = uv[keep], True
        field, known = field.reshape(rows, columns, 2), known.reshape(rows, columns)
        measured = known.copy()

        def around(values: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            padded, there = np.pad(values * inside[:, :, None], ((1, 1), (1, 1), (0, 0))), np.pad(inside.astype(int), 1)
            boxes = [(slice(i, i + rows), slice(j, j + columns)) for i in range(3) for j in range(3)]
            return sum(padded[b] for b in boxes), sum(there[b] for b in boxes)

        while known.any() and not known.all():
            total, n = around(field, known)
            fresh = ~known & (n > 0)
            field[fresh] = total[fresh] / n[fresh][:, None]
            known |= fresh
        for _ in range(passes if known.any() else 0):
            total, n = around(field, np.ones_like(known))
            field = np.where(measured[:, :, None], field, total / n[:, :, None])
        r, c = np.divmod(np.arange(rows * columns if known.any() else 0), columns)
        frame = pa.array([mine.column("frame")[0].as_py()] * len(r), mine.schema.field("frame").type)
        return pa.table([frame, pa.array(r), pa.array(c), pa.array(field[r, c, 0]), pa.array(field[r, c, 1]), pa.array(measured[r, c])], names=["frame", "block_row", "block_col", "d_row", "d_col", "measured"])

    kind = vectors.schema["frame"].dataType.simpleString()
    own = vectors.select("frame", F.col("block_row").cast("long").alias("block_row"), F.col("block_col").cast("long").alias("block_col"), F.col("d_row").cast("double").alias("d_row"), F.col("d_col").cast("double").alias("d_col"))
    return own.groupBy("frame").applyInArrow(run, f"frame {kind}, block_row long, block_col long, d_row double, d_col double, measured boolean")


def advect(frames: DataFrame, vectors: DataFrame, block: int, substeps: int = 2) -> DataFrame:
    """The next frame by going back along the motion of the blocks passed: (frame, row_idx, col_idx, value), frame as of the forecast.

    Each cell is followed back in substeps and takes the value of the nearest source cell; a path through a block without
    motion stays where it is, and a cell whose source has no value gets no row.
    """
    at = frames.select("frame", "row_idx", "col_idx", F.col("row_idx").cast("double").alias("y"), F.col("col_idx").cast("double").alias("x"))
    for _ in range(substeps):
        at = at.withColumns({"block_row": F.floor((F.col("y") + 0.5) / block), "block_col": F.floor((F.col("x") + 0.5) / block)})
        at = at.join(vectors, ["frame", "block_row", "block_col"], "left")
        at = at.select("frame", "row_idx", "col_idx", *[(F.col(p) - F.coalesce(F.col(d), F.lit(0.0)) / substeps).alias(p) for p, d in (("y", "d_row"), ("x", "d_col"))])
    source = frames.select("frame", F.col("row_idx").alias("from_row"), F.col("col_idx").alias("from_col"), "value")
    at = at.withColumns({"from_row": F.floor(F.col("y") + 0.5), "from_col": F.floor(F.col("x") + 0.5)})
    return at.join(source, ["frame", "from_row", "from_col"]).select((F.col("frame") + 1).alias("frame"), "row_idx", "col_idx", "value")


def skill(forecast: DataFrame, observed: DataFrame, thresholds: list[float]) -> DataFrame:
    """Hits, misses and false alarms of each threshold over the cells that both have, and the critical success index."""
    cell = ["frame", "row_idx", "col_idx"]
    both = forecast.select(*cell, F.col("value").alias("said")).join(observed.select(*cell, F.col("value").alias("seen")), cell)
    both = both.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    said, seen = F.col("said") >= F.col("threshold"), F.col("seen") >= F.col("threshold")
    out = both.groupBy("threshold").agg(F.count_if(said & seen).alias("hits"), F.count_if(~said & seen).alias("misses"), F.count_if(said & ~seen).alias("false_alarms"))
    return out.withColumn("csi", F.try_divide(F.col("hits"), F.col("hits") + F.col("misses") + F.col("false_alarms")))


def common_skill(forecasts: dict[str, DataFrame], observed: DataFrame, thresholds: list[float]) -> DataFrame:
    """skill of each forecast by name, over the cells that the analysis and all forecasts have, so that all are scored on one sample."""
    cell = ["frame", "row_idx", "col_idx"]
    both = observed.select(*cell, F.col("value").alias("_seen"))
    for name, said in forecasts.items():
        both = both.join(said.select(*cell, F.col("value").alias(f"_{name}")), cell)
    methods = F.array(*[F.struct(F.lit(n).alias("method"), F.col(f"_{n}").alias("said")) for n in forecasts])
    long = both.select("_seen", F.explode(methods).alias("m")).select("_seen", "m.*").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    said, seen = F.col("said") >= F.col("threshold"), F.col("_seen") >= F.col("threshold")
    counts = [F.count_if(said & seen).alias("hits"), F.count_if(~said & seen).alias("misses"), F.count_if(said & ~seen).alias("false_alarms")]
    out = long.groupBy("method", "threshold").agg(*counts)
    return out.withColumn("csi", F.try_divide(F.col("hits"), F.col("hits") + F.col("misses") + F.col("false_alarms")))


def motion_vectors(vectors: DataFrame, block: int, west: float, north: float, d_lon: float, d_lat: float, width: int, height: int, seconds: float) -> DataFrame:
    """Block motions in pixels a frame as metres a second to the east and north, at block centres; quality 1 if measured, else 0."""
    centre = lambda at, size: F.greatest(F.lit(0.0), F.least((F.col(at) + 0.5) * block, F.lit(size - 0.5)))
    lat, degree = north - centre("block_row", height) * d_lat, 6_371_000.0 * math.pi / 180
    return vectors.select(
        "frame", (west + centre("block_col", width) * d_lon).alias("lon"), lat.alias("lat"),
        (F.col("d_col") * d_lon * degree * F.cos(F.radians(lat)) / seconds).alias("u"), (-F.col("d_row") * d_lat * degree / seconds).alias("v"),
        F.when(F.col("measured"), 1.0).otherwise(0.0).alias("quality"),
    )
