"""Selections. All are column predicates or semi/anti joins, so scans can prune by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.functions.geo import haversine


def bbox(df: DataFrame, west: float, south: float, east: float, north: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points in a box, edges included; west > east crosses the antimeridian."""
    x = F.col(lon)
    inside = x.between(west, east) if west <= east else (x >= west) | (x <= east)
    return df.filter(inside & F.col(lat).between(south, north))


def time(df: DataFrame, start=None, end=None, column: str = "time") -> DataFrame:
    """A closed interval; None leaves an end open."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        keep = keep & (F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return df.filter(keep)


def time_list(df: DataFrame, instants: DataFrame, column: str = "time") -> DataFrame:
    """Rows at any of the instants (one column of that name)."""
    return df.join(instants.select(column).distinct(), column, "left_semi")


def radius(df: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Points within metres of a point; a box on latitude prunes first."""
    near = F.abs(F.col("lat") - lat) <= metres / 111_000.0
    return df.filter(near & (haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) <= metres))


def properties(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """All equalities hold; a list is alternatives; null never matches."""
    for name, value in wanted.items():
        df = df.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return df


def exclude_where(df: DataFrame, rules: list[dict[str, object]]) -> DataFrame:
    """Leaves out rows that match all properties of any rule."""
    drop: Column = F.lit(False)
    for rule in rules:
        one: Column = F.lit(True)
        for name, value in rule.items():
            one = one & (F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
        drop = drop | F.coalesce(one, F.lit(False))
    return df.filter(~drop)


def stations_with_data(stations: DataFrame, obs: DataFrame, start=None, end=None) -> DataFrame:
    return stations.join(time(obs.filter("value is not null"), start, end).select("station_id"), "station_id", "left_semi")


def value_rules(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Values outside a parameter's valid range, or a sentinel, become null; the row stays.

    rules: parameter, low, high, sentinels; one row a parameter, a small dimension.
    """
    joined = obs.join(rules, "parameter", "left")
    bad = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high")) | F.array_contains("sentinels", F.col("value"))
    return joined.withColumn("value", F.when(~F.coalesce(bad, F.lit(False)), F.col("value"))).drop("low", "high", "sentinels")


def active_at(df: DataFrame, at: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Windows that hold an instant; a null end is open."""
    return df.filter((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (at <= F.col(end))))


def overlaps(df: DataFrame, since: Column, until: Column, start: str = "start", end: str = "end") -> DataFrame:
    return df.filter((F.col(start).isNull() | (F.col(start) <= until)) & (F.col(end).isNull() | (F.col(end) >= since)))


def renderable(alerts: DataFrame) -> DataFrame:
    """Without Cancel, Ack and Error messages."""
    return alerts.filter(~F.lower(F.trim("msg_type")).isin("cancel", "ack", "error"))
