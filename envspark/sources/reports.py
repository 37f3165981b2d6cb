"""Decoded report elements to rows of parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far periods (hours) and places (degrees) of one observation may differ.
PERIOD_HOURS, SAME_DEGREES = 0.25, 0.01


@dataclass(frozen=True)
class Rule:
    """A parameter is the first of codes that has a value, over a period if one is given, times scale plus offset."""

    parameter: str
    codes: tuple[str, ...]
    period_hours: float | None = None
    scale: float = 1.0
    offset: float = 0.0

    def chosen(self) -> Column:
        fits = F.col("code").isin(*self.codes) & F.col("value").isNotNull() & ~F.isnan("value")
        if self.period_hours is not None:
            fits &= F.abs(F.col("period_hours") - self.period_hours) < PERIOD_HOURS
        rank = F.coalesce(*[F.when(F.col("code") == c, F.lit(i)) for i, c in enumerate(self.codes)])
        first = F.min_by("value", F.when(fits, F.struct(rank.alias("rank"), F.col("report").alias("report"), F.col("ord").alias("ord"))))
        return (first * self.scale + self.offset).alias(self.parameter)


def extract(elements: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a (station_id, time) of elements (station_id, time, report, ord, lon, lat, elevation, code, value, period_hours), with a column a rule.

    Reports of a station and time come in the order of report (a report has one place), their elements in that of ord; equal ones are the caller's
    to tell apart. Reports are one observation while they lie within 0.01 degrees of its first; a farther one starts another, and the last one counts.
    Null and NaN values are missing, a parameter without a value is null; without a station, time or place there is no row.
    """
    known = elements.filter("station_id is not null and time is not null and report is not null and lon is not null and lat is not null")
    key = ["station_id", "time"]
    # the reports of one station at one instant: a few, and of each a place only
    places = known.groupBy(*key, "report").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("report", "lat", "lon"))).alias("places"))
    near = lambda a, b: (F.abs(a.lat - b.lat) <= SAME_DEGREES) & (F.abs(a.lon - b.lon) <= SAME_DEGREES)
    first = F.aggregate("places", F.col("places")[0], lambda a, b: F.when(near(a, b), a).otherwise(b))
    of_last = places.select(*key, first.alias("f")).select(*key, F.col("f.report").alias("since"), F.col("f.lon").alias("lon"), F.col("f.lat").alias("lat"))
    kept = known.drop("lon", "lat").join(of_last, key).filter("report >= since")
    elevation = F.min_by("elevation", F.when(F.col("elevation").isNotNull(), F.struct("report", "ord"))).alias("elevation")
    return kept.groupBy(*key).agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"), elevation, *[r.chosen() for r in rules])
