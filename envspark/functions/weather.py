"""Derived weather quantities as column expressions; a missing or impossible input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tetens over water, ratio of gas constants, gravity, and Z-R.
E0, A, T0, T1 = 611.21, 17.502, 273.16, 32.19
EPSILON, GRAVITY = 0.62198, 9.80665
ZR_A, ZR_B, ZR_MIN = 200.0, 1.6, 7.0


def finite(v: Column) -> Column:
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees that the wind comes from, in [0, 360); calm is null."""
    return F.when((u != 0) | (v != 0), F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0)))


def saturation_pressure(t: Column) -> Column:
    """Pa from K."""
    return F.when(t > T1, E0 * F.exp(A * (t - T0) / (t - T1)))


def dew_point(pressure: Column) -> Column:
    """K from vapour pressure in Pa."""
    x = F.ln(pressure / E0)
    return F.when((pressure > 0) & (x < A), (A * T0 - T1 * x) / (A - x))


def vapour_pressure(q: Column, p: Column) -> Column:
    return F.when((q >= 0) & (p > 0), q * p / (EPSILON + (1 - EPSILON) * q))


def relative_humidity(t: Column, td: Column) -> Column:
    """Per cent, held in 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * saturation_pressure(td) / saturation_pressure(t)))


def rain_rate(dbz: Column) -> Column:
    """mm/h; below ZR_MIN none, null stays null."""
    return F.when(dbz < ZR_MIN, 0.0).when(dbz.isNotNull(), F.pow(F.pow(F.lit(10.0), dbz / 10) / ZR_A, F.lit(1 / ZR_B)))


def calibrate(raw: Column, scale: float, offset: float, nodata: float) -> Column:
    return F.when(raw != nodata, raw * scale + offset)


def cell_severity(dbz: Column, area_km2: Column) -> Column:
    """0 to 3: a step for each of 45, 50 and 55 dBZ and one for 50 km2; three steps and more are one class."""
    step = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return F.least(F.lit(3), step(dbz >= 45) + step(dbz >= 50) + step(dbz >= 55) + step(area_km2 >= 50))


def stretch(v: Column, low: float, high: float, gamma: float = 1.0) -> Column:
    """0 to 255; low > high inverts."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low)))
    return F.round(255 * F.pow(share, F.lit(1 / gamma))).cast("int")


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration of weeks, days, hours, minutes and seconds; null if it isn't one."""
    pattern = r"^P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    parts = [F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("long"), F.lit(0)) * s for k, s in enumerate((604800, 86400, 3600, 60, 1), 1)]
    return F.when(text.rlike(pattern) & ~text.rlike("[PT]$"), sum(parts[1:], parts[0]))


def classify(v: Column, breaks: list[float]) -> Column:
    """How many of the ascending breaks v reaches."""
    return F.when(v.isNotNull(), sum(((v >= b).cast("int") for b in breaks[1:]), (v >= breaks[0]).cast("int")))
