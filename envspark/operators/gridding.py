"""Stations to grids: nearest, inverse distance, and leave-one-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.operators.joins import nearest

COINCIDENT_M = 1e-3


def _weighted(near: DataFrame, k: int, power: float) -> DataFrame:
    """Of rows (id, station_id, distance, value): (distance of the nearest / distance)^power over the k nearest; coincident ones averaged."""
    near = near.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("distance", "station_id"))).filter(F.col("n") <= k)
    near = near.withColumn("first", F.min("distance").over(W.partitionBy("id")))
    w = F.when(F.col("first") < COINCIDENT_M, (F.col("distance") < COINCIDENT_M).cast("double")).otherwise(F.pow(F.col("first") / F.col("distance"), F.lit(power)))
    return near.groupBy("id").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("estimate"), F.count("*").alias("neighbours"), F.min_by("value", F.struct("distance", "station_id")).alias("nearest"))


def idw(targets: DataFrame, stations: DataFrame, values: DataFrame, metres: float, k: int = 8, power: float = 2.0) -> DataFrame:
    """(id, estimate, neighbours, nearest) at targets (id, lon, lat) from values (station_id, value)."""
    near = nearest(targets, stations.join(values.select("station_id"), "station_id", "left_semi"), metres, k)
    return _weighted(targets.select("id", "lon", "lat").join(near, ["lon", "lat"]).drop("lon", "lat").join(values, "station_id"), k, power)


def leave_one_out(stations: DataFrame, values: DataFrame, metres: float, k: int = 8, power: float = 2.0) -> DataFrame:
    """(station_id, value, estimate, residual, neighbours) with each station estimated from the others."""
    known = stations.join(values.select("station_id"), "station_id", "left_semi")
    targets = known.select(F.col("station_id").alias("id"), "lon", "lat")
    near = targets.join(nearest(known, known, metres, k + 1), ["lon", "lat"]).drop("lon", "lat").filter("id <> station_id").join(values, "station_id")
    est = _weighted(near, k, power)
    return est.join(values.withColumnRenamed("station_id", "id"), "id").select(F.col("id").alias("station_id"), "value", "estimate", (F.col("estimate") - F.col("value")).alias("residual"), "neighbours")


def rmse(residuals: DataFrame) -> DataFrame:
    return residuals.agg(F.count("residual").alias("n"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))


#: Fixed value: change of air temperature with height where none is given, in kelvins a kilometre.
LAPSE_K_PER_KM = -6.5


def with_lapse(targets: DataFrame, stations: DataFrame, values: DataFrame, metres: float, k_per_km: float = LAPSE_K_PER_KM, k: int = 8, power: float = 2.0) -> DataFrame:
    """(id, estimate, neighbours) at targets (id, lon, lat, height) from stations (station_id, lon, lat, elevation) and values (station_id, value).

    Values are reduced to sea level by the lapse rate, weighted there, and raised to the target's height. Stations without a height take
    no part; a target without one has a null estimate.
    """
    rate = k_per_km / 1000.0
    high = stations.filter(F.col("elevation").isNotNull() & ~F.isnan("elevation"))
    low = values.join(high.select("station_id", "elevation"), "station_id").select("station_id", (F.col("value") - rate * F.col("elevation")).alias("value"))
    est = idw(targets, high, low, metres, k, power).join(targets.select("id", "height"), "id")
    return est.select("id", F.when(~F.isnan("height"), F.col("estimate") + rate * F.col("height")).alias("estimate"), "neighbours")


def masked(cells: DataFrame, mask: DataFrame, unit: str, column: str = "estimate") -> DataFrame:
    """cells (id, column) with column null where the mask (id, land) has less than half a cell of land, or nothing; unit is '1' or '%'."""
    least = {"1": 0.5, "%": 50.0}.get(unit)
    if least is None:
        raise ValueError(f"a land mask is a fraction (1) or per cent (%), not {unit!r}")
    land = cells.join(mask.select("id", (F.col("land") >= least).alias("_land")), "id", "left")
    return land.withColumn(column, F.when(F.col("_land"), F.col(column))).drop("_land")
