"""Grids of areas: the cells of a polygon, and values in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.operators.joins import edges, held
from envspark.operators.nowcast import _saved
from envspark.operators.paths import sampled


def _span(axis: str) -> tuple[Column, Column]:
    ring = F.transform(F.get("rings", F.lit(0)), lambda p: p[axis])
    return F.array_min(ring), F.array_max(ring)


def area_cells(areas: DataFrame, dx: float, dy: float, most: int | None = None) -> DataFrame:
    """(area_id, ix, iy, lon, lat, inside, coarsened) of areas (area_id, rings): cells of dx by dy degrees over each one's box, a partial one whole, from the north-west.

    A cell is inside when its centre is, by the rule of points_in_areas. Where no centre is, the cells nearest to the vertices are, so that a
    small shape has a cell too. Of a rectangle every cell is. An area of more than most cells gets evenly coarser ones, the most that fit, and
    says so. Rings may run past 180 degrees; lon is given within them. Areas without an outer ring have no row.
    """
    (w, e), (s, n) = _span("x"), _span("y")
    outer = F.get("rings", F.lit(0))
    box = areas.select("area_id", "rings", w.alias("w"), e.alias("e"), s.alias("s"), n.alias("n")).filter("w is not null and s is not null")
    box = _saved(box)  # one row an area; what follows names these columns often
    nx, ny = F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("w")) / dx)), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("s")) / dy))
    box = box.withColumns({"nx": nx, "ny": ny, "coarsened": F.lit(False)})
    if most is not None:
        fewer = F.greatest(F.lit(1), F.floor(F.col("nx") / F.sqrt(F.col("nx") * F.col("ny") / most)))
        fewer = F.least(F.col("nx"), F.greatest(fewer, F.ceil(most / F.col("ny") - 1)), F.lit(most))  # a flat axis of a cell leaves the other all
        box = box.withColumn("coarsened", F.col("nx") * F.col("ny") > most).withColumn("nx", F.when(F.col("coarsened"), fewer).otherwise(F.col("nx")))
        box = box.withColumn("ny", F.when(F.col("coarsened"), F.least(F.col("ny"), F.floor(most / F.col("nx")))).otherwise(F.col("ny")))
    corner = F.forall(outer, lambda p: (p.x == F.col("w")) | (p.x == F.col("e"))) & F.forall(outer, lambda p: (p.y == F.col("s")) | (p.y == F.col("n")))
    box = box.withColumns({"whole": (F.size("rings") == 1) & (F.size(outer) == 5) & corner, "cw": (F.col("e") - F.col("w")) / F.col("nx"), "ch": (F.col("n") - F.col("s")) / F.col("ny")})
    to = lambda c: F.sequence(F.lit(0), F.col(c).cast("int") - 1)
    box = _saved(box)
    cells = box.drop("rings").withColumn("ix", F.explode(to("nx"))).withColumn("iy", F.explode(to("ny")))
    cells = cells.withColumns({"lon": F.col("w") + (F.col("ix") + 0.5) * F.col("cw"), "lat": F.col("n") - (F.col("iy") + 0.5) * F.col("ch")})
    asked = cells.filter("not whole").select(F.struct("area_id", "ix", "iy").alias("id"), "lon", "lat", "area_id")
    inside = held(asked, edges(box.select("area_id", F.filter("rings", lambda r: F.size(r) > 1).alias("rings")))).select("id.area_id", "id.ix", "id.iy")
    nearest = lambda share, count: F.least(F.col(count) - 1, F.greatest(F.lit(0), F.ceil(share - 1))).cast("int")
    bare = box.filter("not whole").join(inside.select("area_id").distinct(), "area_id", "left_anti")
    vertex = bare.select("area_id", "w", "n", "cw", "ch", "nx", "ny", F.explode(F.flatten("rings")).alias("p"))
    vertex = vertex.select("area_id", F.coalesce(nearest(F.try_divide(F.col("p.x") - F.col("w"), F.col("cw")), "nx"), F.lit(0)).alias("ix"), F.coalesce(nearest(F.try_divide(F.col("n") - F.col("p.y"), F.col("ch")), "ny"), F.lit(0)).alias("iy"))
    marked = cells.join(inside.union(vertex).distinct().withColumn("_in", F.lit(True)), ["area_id", "ix", "iy"], "left")
    lon = F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    return marked.select("area_id", "ix", "iy", lon.alias("lon"), "lat", (F.col("whole") | F.coalesce("_in", F.lit(False))).alias("inside"), "coarsened")


def area_values(cells: DataFrame, grid: DataFrame, keys: list[str], west: float, north: float, dx: float, dy: float) -> DataFrame:
    """cells of area_cells for every key of the grid (keys, row_idx, col_idx, value), with its value there as paths.sampled gives it; null outside the area."""
    every = _saved(grid.select(*keys).distinct())
    wanted = _saved(_saved(cells).crossJoin(every))  # the answer has a row for each
    found = sampled(wanted.filter("inside"), grid, keys, west, north, dx, dy)
    return found.unionByName(wanted.filter("not inside"), allowMissingColumns=True)
