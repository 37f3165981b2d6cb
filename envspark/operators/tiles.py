"""Features cut to Web Mercator tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.functions import geo
from envspark.operators.grids import dealt

#: Units across a tile, and how far past its border geometry reaches, as a share of the tile.
EXTENT, BUFFER = 4096, 1 / 16


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _unrolled(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """A place in tiles from the west and the north edge of the map."""
    x, y = geo.mercator(lon, lat)
    turn = geo.TAU * geo.MERCATOR_M
    return (x / turn + 0.5) * (1 << zoom), (0.5 - y / turn) * (1 << zoom)


def _reached(low: Column, high: Column, zoom: int) -> Column:
    """Numbers of the tiles that a span reaches with their buffers."""
    first, last = F.greatest(F.lit(0), F.ceil(low - 1 - BUFFER)), F.least(F.lit((1 << zoom) - 1), F.floor(high + BUFFER))
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))


def _cut(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """The part of a ring (points x, y; its end joins its start) on one side of a line, the line included."""
    other = "y" if axis == "x" else "x"
    kept = lambda p: p[axis] >= bound if above else p[axis] <= bound

    def step(r: Column, p: Column, i: Column) -> Column:
        was = F.when(i == 0, r[F.size(r) - 1]).otherwise(r[i - 1])
        share = F.try_divide(bound - was[axis], p[axis] - was[axis])
        place = {axis: bound, other: was[other] + share * (p[other] - was[other])}
        crossing = F.struct(place["x"].alias("x"), place["y"].alias("y"))
        here = F.struct(p.x.alias("x"), p.y.alias("y"))
        return F.when(kept(was) & kept(p), F.array(here)).when(kept(was), F.array(crossing)).when(kept(p), F.array(crossing, here)).otherwise(F.slice(F.array(here), 1, 0))

    return _once(ring, lambda r: F.flatten(F.transform(r, lambda p, i: step(r, p, i))))


def _strip(rings: Column, axis: str, tile: Column) -> Column:
    low, high = tile - BUFFER, tile + 1 + BUFFER
    return F.transform(rings, lambda r: _cut(_cut(r, axis, low, True), axis, high, False))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring: above 0 clockwise where y runs down."""
    twice = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, i: s + r[i - 1].x * r[i].y - r[i].x * r[i - 1].y)
    return _once(ring, lambda r: F.when(F.size(r) < 4, F.lit(0.0)).otherwise(twice(r) / 2))


def tile_polygons(features: DataFrame, keys: list[str], zoom: int) -> DataFrame:
    """(keys, tile_x, tile_y, rings) of polygons (keys, rings of points x, y in degrees): what lies in each tile or its buffer.

    Points are in units of the tile, y down; rings are closed, the outer one (the first) clockwise to the eye, holes the other way. A tile that
    the outer ring doesn't reach has no row, nor has a polygon without an outer ring or with a null or NaN in it; holes of fewer than three
    points go. Parts of a feature are rows told apart by a key. A polygon is cut into strips before strips are cut into tiles, so that none
    is copied whole to every tile. Strips come out of generators, so that a filter on one doesn't cut it again.
    """

    def opened(ring: Column) -> Column:
        last = F.element_at(ring, -1)
        return F.when((F.size(ring) > 1) & (ring[0].x == last.x) & (ring[0].y == last.y), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)

    place = lambda p: F.struct(*[v.alias(c) for c, v in zip("xy", _unrolled(p.x.cast("double"), p.y.cast("double"), zoom))])
    sound = F.forall("rings", lambda r: r.isNotNull() & F.forall(r, lambda p: p.x.isNotNull() & p.y.isNotNull() & ~F.isnan(p.x.cast("double")) & ~F.isnan(p.y.cast("double")))) & (F.size("rings") > 0)
    at = dealt(features).filter(sound).filter(F.size(F.get("rings", F.lit(0))) > 0).select(*keys, F.filter("rings", lambda r: F.size(r) > 0).alias("rings"))
    at = at.withColumn("rings", F.transform("rings", lambda r: F.transform(_once(r, opened), place)))
    ends = lambda axis: (F.array_min(F.transform(F.col("rings")[0], lambda p: p[axis])), F.array_max(F.transform(F.col("rings")[0], lambda p: p[axis])))
    columns = at.withColumn("tile_x", F.explode(_reached(*ends("x"), zoom)))
    columns = columns.withColumn("rings", F.explode(F.array(_strip(F.col("rings"), "x", F.col("tile_x").cast("double"))))).filter(F.size(F.col("rings")[0]) > 0)
    tiles = columns.withColumn("tile_y", F.explode(_reached(*ends("y"), zoom)))
    tiles = tiles.withColumn("rings", F.explode(F.array(_strip(F.col("rings"), "y", F.col("tile_y").cast("double"))))).filter(F.size(F.col("rings")[0]) >= 3)

    def finished(ring: Column, number: Column) -> Column:
        local = F.transform(ring, lambda p: F.struct(((p.x - F.col("tile_x")) * EXTENT).alias("x"), ((p.y - F.col("tile_y")) * EXTENT).alias("y")))
        shut = _once(local, lambda r: F.concat(r, F.slice(r, 1, 1)))
        return _once(shut, lambda r: F.when(F.when(number == 0, ring_area(r) < 0).otherwise(ring_area(r) > 0), F.reverse(r)).otherwise(r))

    wanted = F.filter("rings", lambda r: F.size(r) >= 3)
    return tiles.select(*keys, "tile_x", "tile_y", F.transform(wanted, finished).alias("rings"))


def tile_points(points: DataFrame, keys: list[str], zoom: int) -> DataFrame:
    """(keys, tile_x, tile_y, x, y) of points (keys, lon, lat) in each tile whose buffer reaches them, in units of the tile, y down. Null or NaN places have no row."""
    at = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat"))
    u, v = _unrolled(F.col("lon").cast("double"), F.col("lat").cast("double"), zoom)
    at = at.select(*keys, u.alias("u"), v.alias("v")).withColumn("tile_x", F.explode(_reached(F.col("u"), F.col("u"), zoom))).withColumn("tile_y", F.explode(_reached(F.col("v"), F.col("v"), zoom)))
    return at.select(*keys, "tile_x", "tile_y", ((F.col("u") - F.col("tile_x")) * EXTENT).alias("x"), ((F.col("v") - F.col("tile_y")) * EXTENT).alias("y"))
