"""Grid operators over long cells (row_idx, col_idx, value); missing cells are absent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))  # rows and columns past the first


def squares(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_idx, col_idx, v0, v1, v2, v3): values of the corners of each square of cells, by its first corner's numbers; a missing corner is null."""
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("corner"), (F.col("row_idx") - dr).cast("int").alias("row_idx"), (F.col("col_idx") - dc).cast("int").alias("col_idx")) for k, (dr, dc) in enumerate(_CORNERS)]))
    each = cells.filter("value is not null").select(*keys, "value", corner.alias("c")).select(*keys, "value", "c.*")
    return each.groupBy(*keys, "row_idx", "col_idx").agg(*[F.max(F.when(F.col("corner") == k, F.col("value"))).alias(f"v{k}") for k in range(4)])


def weights(x: Column, y: Column) -> list[Column]:
    """w0 to w3: what the corners of the square around x, y (in cell units) weigh there."""
    fx, fy = x - F.floor(x), y - F.floor(y)
    return [w.alias(f"w{k}") for k, w in enumerate(((1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy))]


def in_square() -> Column:
    """The value by the columns of squares() and weights(): with all four corners weighted, else that of the heaviest corner present, in corner order on ties."""
    v, w = [F.col(f"v{k}") for k in range(4)], [F.col(f"w{k}") for k in range(4)]
    most = F.greatest(*[F.when(v[k].isNotNull(), w[k]) for k in range(4)])
    heaviest = F.coalesce(*[F.when(w[k] == most, v[k]) for k in range(4)])
    return F.coalesce(w[0] * v[0] + w[1] * v[1] + w[2] * v[2] + w[3] * v[3], heaviest)  # added in a fixed order


def dealt(df: DataFrame) -> DataFrame:
    """df dealt over the session's shuffle partitions: few rows that become many in a join need more tasks than their files give."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def position(points: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Bilinear values at points (id, x, y in cell units) for every key of the cells, by the rule of in_square.

    A point meets the squares of its cell, which hold their four corners, so that neither its corners nor its values are shuffled. ids are unique.
    """
    at = dealt(points.select("id", F.floor("y").cast("int").alias("row_idx"), F.floor("x").cast("int").alias("col_idx"), *weights(F.col("x"), F.col("y"))))
    return at.join(squares(cells, keys), ["row_idx", "col_idx"]).select("id", *keys, in_square().alias("value"))


def smooth(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Binomial 1-2-1 along rows, then columns, renormalised over the cells present."""
    for axis in ("col_idx", "row_idx"):
        spread = cells.select(*keys, "row_idx", "col_idx", "value", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-1, 1.0), (0, 2.0), (1, 1.0))])).alias("n"))
        moved = spread.withColumn(axis, F.col(axis) + F.col("n.d"))
        cells = moved.groupBy(*keys, "row_idx", "col_idx").agg(
            (F.sum(F.when(F.col("value").isNotNull(), F.col("value") * F.col("n.w"))) / F.sum(F.when(F.col("value").isNotNull(), F.col("n.w")))).alias("value"), F.max(F.when((F.col("n.d") == 0) & F.col("value").isNotNull(), 1)).alias("own")
        ).filter("own = 1").drop("own")
    return cells


def tiles(cells: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Pyramid: at level z a tile is 2^z cells wide; count, mean and maximum of each."""
    each = cells.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    each = each.withColumn("tile_row", F.floor(F.col("row_idx") / F.pow(F.lit(2), "z")).cast("int")).withColumn("tile_col", F.floor(F.col("col_idx") / F.pow(F.lit(2), "z")).cast("int"))
    return each.groupBy(*keys, "z", "tile_row", "tile_col").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))


def regrid_nearest(cells: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the nearest cells at targets (t_row, t_col, x, y in source cell units)."""
    at = targets.withColumn("row_idx", F.floor(F.col("y") + 0.5).cast("int")).withColumn("col_idx", F.floor(F.col("x") + 0.5).cast("int"))
    return at.join(cells, ["row_idx", "col_idx"]).select(*keys, "t_row", "t_col", "value")


def event_age(events: DataFrame, now, size: float, window_min: int) -> DataFrame:
    """(row_idx, col_idx, age_min): age of each cell's newest event in the half-open window before now."""
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("time").cast("timestamp"))) / 60.0
    near = events.withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") < window_min))
    return near.groupBy(F.floor(F.col("lat") / size).cast("int").alias("row_idx"), F.floor(F.col("lon") / size).cast("int").alias("col_idx")).agg(F.min("age").alias("age_min"))


def regrid(cells: DataFrame, keys: list[str], source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Cells of a target grid over the same extent, each with the value of the source cell under its centre."""
    rows, columns = target
    n = F.col("id")
    to = cells.sparkSession.range(rows * columns).select(F.floor(n / columns).alias("to_row"), (n % columns).alias("to_col"))
    to = to.withColumns({"row_idx": F.floor((2 * F.col("to_row") + 1) * source[0] / (2 * rows)), "col_idx": F.floor((2 * F.col("to_col") + 1) * source[1] / (2 * columns))})
    return cells.join(to, ["row_idx", "col_idx"]).select(*keys, F.col("to_row").alias("row_idx"), F.col("to_col").alias("col_idx"), "value")
