"""Polar radar volumes as tables of gates (site, elangle, azimuth, range_idx, dbz)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(gates: DataFrame, points: DataFrame) -> DataFrame:
    """Value per sweep at each point (id, site, azimuth, range_idx): clear air is null, a gate that no sweep has gives no row."""
    best = gates.groupBy("site", "elangle", "azimuth", "range_idx").agg(F.max("dbz").alias("dbz"))
    return points.join(best, ["site", "azimuth", "range_idx"]).select("id", "site", "elangle", "dbz")


def sweep(gates: DataFrame, angle: float | None = None) -> DataFrame:
    """Gates of each site's sweep nearest to the angle (ties: the lower one) among those with a value; without an angle the lowest."""
    asked = F.abs(F.col("elangle") - angle) if angle is not None else F.lit(0.0)
    chosen = gates.filter("dbz is not null").groupBy("site").agg(F.min(F.struct(asked.alias("off"), "elangle")).alias("s")).select("site", "s.elangle")
    return gates.join(chosen, ["site", "elangle"])


def voxels(gates: DataFrame, ranges: int, azimuths: int, metres: float, height) -> DataFrame:
    """Largest value of each cylindrical voxel (site, i_r, i_a, i_h); height is the column of the gate's height."""
    at = {"i_r": F.floor(F.col("range_idx") / ranges), "i_a": F.floor(F.col("azimuth") / azimuths), "i_h": F.floor(height / metres)}
    return gates.withColumns(at).groupBy("site", *at).agg(F.max("dbz").alias("dbz"))
