"""Lines over grids: contours of a field, and samples of a field along a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.operators import grids

#: Fixed value: levels drawn in one cell at most, the lowest first.
LEVELS_PER_CELL = 4


def contours(cells: DataFrame, keys: list[str], base: float, interval: float) -> DataFrame:
    """(keys, row_idx, col_idx, level, part, x1, y1, x2, y2): segments of the lines at base + k * interval, by marching squares.

    cells: keys, row_idx, col_idx, value. A square has its upper left cell's numbers, and x and y count cells from the first one's centre. Squares with
    a missing or null corner, or no range of values, have none. A level passes between corners at it or above and corners below; at a
    saddle the mean decides which corners join. An edge's point is reckoned from its first cell, the same for both squares.
    """
    known = cells.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, "row_idx", "col_idx", "value")
    row = W.partitionBy(*keys, "row_idx").orderBy("col_idx")  # as many rows as the grid is wide
    pairs = known.select(*keys, "row_idx", "col_idx", F.col("value").alias("l"), F.lead("value").over(row).alias("r"), F.lead("col_idx").over(row).alias("next")).filter("next = col_idx + 1").drop("next")
    lower = pairs.select(*keys, (F.col("row_idx") - 1).alias("row_idx"), "col_idx", F.col("l").alias("bl"), F.col("r").alias("br"))
    square = pairs.withColumnsRenamed({"l": "tl", "r": "tr"}).join(lower, [*keys, "row_idx", "col_idx"])
    low, high = F.least("tl", "tr", "bl", "br"), F.greatest("tl", "tr", "bl", "br")
    first, last = F.ceil((low - base) / interval), F.floor((high - base) / interval)
    square = square.filter(low < high).withColumns({"_f": first, "_l": F.least(last, first + (LEVELS_PER_CELL - 1))}).filter("_l >= _f")
    at = square.withColumn("k", F.explode(F.sequence("_f", "_l"))).withColumn("level", F.lit(base) + F.col("k") * F.lit(interval))
    v, x, y = F.col("level"), F.col("col_idx").cast("double"), F.col("row_idx").cast("double")
    share = lambda a, b: (v - F.col(a)) / (F.col(b) - F.col(a))
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    top, bottom = point(x + share("tl", "tr"), y), point(x + share("bl", "br"), y + 1)
    left, right = point(x, y + share("tl", "bl")), point(x + 1, y + share("tr", "br"))
    bit = lambda c, n: F.when(F.col(c) >= v, n).otherwise(0)
    at = at.withColumn("case", bit("tl", 1) + bit("tr", 2) + bit("br", 4) + bit("bl", 8)).filter(~F.col("case").isin(0, 15))
    through = ((F.col("tl") + F.col("tr") + F.col("br") + F.col("bl")) / 4 >= v) == (F.col("case") == 5)
    line = lambda *ends: F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ends])
    lines = F.when(F.col("case").isin(1, 14), line((left, top))).when(F.col("case").isin(2, 13), line((top, right))).when(F.col("case").isin(3, 12), line((left, right)))
    lines = lines.when(F.col("case").isin(4, 11), line((right, bottom))).when(F.col("case").isin(6, 9), line((top, bottom))).when(F.col("case").isin(7, 8), line((left, bottom)))
    lines = lines.when(through, line((top, right), (left, bottom))).otherwise(line((left, top), (right, bottom)))
    out = at.select(*keys, "row_idx", "col_idx", "level", F.posexplode(lines).alias("part", "s"))
    return out.select(*keys, "row_idx", "col_idx", "level", "part", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def wrapped(lon: Column) -> Column:
    """A longitude in (-180, 180]; one that is there stays as it is, to the last bit."""
    return F.when((lon > -180) & (lon <= 180), lon).otherwise(F.lit(180.0) - F.pmod(F.lit(180.0) - lon, F.lit(360.0)))


def densify(vertices: DataFrame, dx: float, dy: float) -> DataFrame:
    """(path, n, lon, lat, z, t): samples along great circles, at least one a grid cell of dx by dy degrees.

    vertices: path, place (their order), lon, lat, z and t (null where a path has none). A segment has as many steps as it crosses cells
    along the axis where it crosses more. z and t go on evenly, t to the millisecond; a sample equal to the one before it is left out. A
    segment between opposite points of the globe fails the query, as no single great circle joins them.
    """
    order = W.partitionBy("path").orderBy("place")
    names = ("lon", "lat", "z", "t")
    seg = vertices.select("path", "place", *names, *[F.lead(c).over(order).alias(f"{c}_") for c in names], (F.row_number().over(order) == 1).alias("head"))
    unit = lambda lon, lat: (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))
    a, b = unit(F.col("lon"), F.col("lat")), unit(F.col("lon_"), F.col("lat_"))
    seg = seg.withColumn("d", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a[0] * b[0] + a[1] * b[1] + a[2] * b[2]))))
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(wrapped(F.col("lon_") - F.col("lon"))) / dx, F.abs(F.col("lat_") - F.col("lat")) / dy)))
    opposite = F.col("lon_").isNotNull() & (F.sin("d") < 1e-12) & (F.col("d") >= 1)
    seg = seg.withColumn("steps", F.when(opposite, F.raise_error(F.concat(F.lit("opposite points on path "), F.col("path").cast("string"))).cast("long")).otherwise(steps))
    begun = seg.filter("head").select("path", "place", F.lit(0).cast("long").alias("k"), wrapped(F.col("lon")).alias("lon"), "lat", "z", "t")
    each = seg.filter("lon_ is not null").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("steps"))))
    f, sin_d = F.col("k") / F.col("steps"), F.sin("d")
    wa, wb = F.sin((1 - f) * F.col("d")) / sin_d, F.sin(f * F.col("d")) / sin_d
    p = [wa * a[i] + wb * b[i] for i in range(3)]
    end, same = F.col("k") == F.col("steps"), sin_d < 1e-12
    lon = F.when(end, wrapped(F.col("lon_"))).when(same, wrapped(F.col("lon"))).otherwise(wrapped(F.degrees(F.atan2(p[1], p[0]))))
    lat = F.when(end, F.col("lat_")).when(same, F.col("lat")).otherwise(F.degrees(F.atan2(p[2], F.hypot(p[0], p[1]))))
    z = F.when(end, F.col("z_")).otherwise(F.col("z") + (F.col("z_") - F.col("z")) * f)
    ms = F.unix_millis(F.col("t").cast("timestamp"))
    t = F.when(end, F.col("t_")).otherwise(F.timestamp_millis(ms + F.round((F.unix_millis(F.col("t_").cast("timestamp")) - ms) * f).cast("long")).cast(vertices.schema["t"].dataType))
    samples = begun.union(each.select("path", "place", "k", lon.alias("lon"), lat.alias("lat"), z.alias("z"), t.alias("t")))
    along = W.partitionBy("path").orderBy("place", "k")
    before = F.lag(F.struct(*names)).over(along)
    kept = samples.withColumn("again", before.isNotNull() & before.eqNullSafe(F.struct(*names))).filter(~F.col("again"))
    return kept.withColumn("n", F.row_number().over(along) - 1).select("path", "n", *names)


def _nearest(axis: list, value: Column, literal, key) -> Column:
    """The nearest entry of a short axis, the first on a tie."""
    entries = F.array(*[F.struct(F.abs(key(literal(x)) - key(value)).alias("gap"), F.lit(i).alias("i"), literal(x).alias("x")) for i, x in enumerate(axis)])
    return F.array_min(entries)["x"]


def _nearest_time(times: list[str], t: Column, stamp) -> Column:
    """The nearest of ascending times, the earlier on a tie, by halving."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    if len(times) == 1:
        return stamp(times[0])
    sums = F.array(*[us(stamp(a)) + us(stamp(b)) for a, b in zip(times, times[1:])])  # twice the middles
    n, twice = len(times) - 1, 2 * us(t)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    past = F.aggregate(steps, F.lit(0), lambda i, step: F.when((i + step <= n) & (F.get(sums, i + step - 1) < twice), i + step).otherwise(i))
    return F.get(F.array(*map(stamp, times)), past)


def nodes(samples: DataFrame, times: list[str], levels: list[float], per_time: bool, per_level: bool) -> DataFrame:
    """(path, n, lon, lat, z, t, time, level) of samples on a collection's axes of times (ascending) and levels.

    With per_time each sample is at the time nearest to its own t (the earlier on a tie), and with per_level at the level nearest to its z
    (the first on a tie); a t or z outside the axis fails the query. Otherwise every sample is at every time, or distinct level.
    Without levels level is null and z is ignored.
    """
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    number = lambda x: F.lit(float(x))
    fail = lambda what, kind: F.raise_error(F.concat(F.lit(f"{what} outside of the axis on path "), F.col("path").cast("string"))).cast(kind)
    if per_time:
        t = F.col("t").cast("timestamp_ntz")
        time = F.when((t >= stamp(times[0])) & (t <= stamp(times[-1])), _nearest_time(times, t, stamp)).otherwise(fail("time", "timestamp_ntz"))
    else:
        time = F.explode(F.array(*map(stamp, times)))
    out = samples.withColumn("time", time)
    if not levels:
        return out.withColumn("level", F.lit(None).cast("double"))
    if per_level:
        inside = F.col("z").between(min(levels), max(levels))
        return out.withColumn("level", F.when(inside, _nearest(levels, F.col("z"), number, lambda c: c)).otherwise(fail("level", "double")))
    return out.withColumn("level", F.explode(F.array(*map(number, dict.fromkeys(levels)))))


def sampled(points: DataFrame, cells: DataFrame, keys: list[str], west: float, north: float, dx: float, dy: float) -> DataFrame:
    """points with value: bilinear between cell centres of the cells with equal keys.

    By the rule of grids.in_square; a place without any corner has a null. A grid begins at its north-western corner; columns of points but lon,
    lat and keys pass.
    """
    x, y = (F.col("lon") - west) / dx - 0.5, (north - F.col("lat")) / dy - 0.5
    at = points.select("*", F.floor(y).cast("int").alias("_row"), F.floor(x).cast("int").alias("_col"), *grids.weights(x, y))
    squares = grids.squares(cells.select(*keys, "row_idx", "col_idx", "value"), keys).withColumnsRenamed({"row_idx": "_row", "col_idx": "_col"})
    found = at.join(squares, [*keys, "_row", "_col"], "left").withColumn("value", grids.in_square())
    return found.select(*keys, *[c for c in points.columns if c not in keys], "value")
