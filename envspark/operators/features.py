"""Features, parameters, levels, units and alerts: selections and look-ups beyond plain filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.functions.geo import beam_height, haversine

#: Source unit, shown unit, scale and offset.
DISPLAY = [("K", "°C", 1.0, -273.15), ("Pa", "hPa", 0.01, 0.0), ("kg m-2", "mm", 1.0, 0.0), ("kg m-2 s-1", "mm/h", 3600.0, 0.0)]
#: Codes of alert severities.
SEVERITY = {"extreme": 4, "severe": 3, "moderate": 2, "minor": 1}


def select_parameters(available: DataFrame, requested: DataFrame) -> DataFrame:
    """(position, parameter) of requested names (position, name): the exact name, else the first one (by place) that is equal but for case.

    available: place, parameter. A repeat collapses to its first position. A name that isn't available fails the query when it runs.
    """
    names = available.select("place", "parameter", F.lower("parameter").alias("key"))
    met = requested.withColumn("key", F.lower("name")).join(names, "key", "left")
    best = met.groupBy("position", "name").agg(F.min_by("parameter", F.struct((F.col("parameter") != F.col("name")).cast("int"), "place")).alias("parameter"))
    known = F.coalesce("parameter", F.raise_error(F.concat(F.lit("no such parameter: "), "name")).cast("string"))
    return best.select("position", known.alias("parameter")).groupBy("parameter").agg(F.min("position").alias("position")).select("position", "parameter")


def level_steps(low: float, step: float, n: int) -> Column:
    """A recurring level selection: n steps after the first level, ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(low) + i * F.lit(step))


def at_levels(rows: DataFrame, levels: Column, column: str = "level") -> DataFrame:
    """Rows at any level of an array, within 1e-9 of its size."""
    near = F.exists(levels, lambda v: F.abs(F.col(column) - v) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(v)))
    return rows.filter(near)


def between_levels(rows: DataFrame, low: float | None, high: float | None, column: str = "level") -> DataFrame:
    """A closed interval; None leaves an end open."""
    return rows.filter((F.col(column) >= low if low is not None else F.lit(True)) & (F.col(column) <= high if high is not None else F.lit(True)))


def boxes_meeting(areas: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rectangular areas (west, south, east, north) that share a point with a box, edges included."""
    return areas.filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))


def masked_cells(cells: DataFrame, inside: Column) -> DataFrame:
    """Cells of a grid with values outside a shape made null; the cell stays."""
    return cells.withColumn("value", F.when(inside, F.col("value")))


def one_language(infos: DataFrame, language: str) -> DataFrame:
    """Of each alert's infos (alert, ordinal, lang) those whose primary subtag is the language's; without one, the first."""
    primary = lambda c: F.lower(F.regexp_extract(F.trim(c), "^[^-_]*", 0))
    match = F.coalesce(primary(F.col("lang")) == primary(F.lit(language)), F.lit(False))
    alert = W.partitionBy("alert")
    marked = infos.withColumn("_match", match).withColumn("_any", F.max("_match").over(alert)).withColumn("_first", F.min("ordinal").over(alert))
    return marked.filter(F.when(F.col("_any"), F.col("_match")).otherwise(F.col("ordinal") == F.col("_first"))).drop("_match", "_any", "_first")


def snap_time(wanted: DataFrame, times: DataFrame) -> DataFrame:
    """(want, time): the latest time not after a wanted instant, else the earliest; of a null one the latest.

    A union of both sides is ordered by time within a day, and days carry the last time of the days before.
    """
    day = lambda c: F.to_date(c)
    known = times.select("time").distinct()
    ends = known.agg(F.min("time").alias("least"), F.max("time").alias("most"))
    daily = known.groupBy(day(F.col("time")).alias("day")).agg(F.max("time").alias("last"))
    asked = wanted.select("want").distinct()
    days = asked.filter("want is not null").select(day(F.col("want")).alias("day")).distinct().join(daily, "day", "full")
    # one row a day: few, and ordered as a whole
    carried = days.withColumn("before", F.last("last", ignorenulls=True).over(W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, -1))).select("day", "before")
    both = asked.filter("want is not null").select(day(F.col("want")).alias("day"), F.col("want").alias("t"), F.lit(1).alias("ask")).union(known.select(day(F.col("time")), "time", F.lit(0)))
    seen = both.withColumn("own", F.last(F.when(F.col("ask") == 0, F.col("t")), ignorenulls=True).over(W.partitionBy("day").orderBy("t", "ask").rowsBetween(W.unboundedPreceding, 0))).filter("ask = 1")
    found = seen.join(carried, "day", "left").crossJoin(F.broadcast(ends)).select(F.col("t").alias("want"), F.coalesce("own", "before", "least").alias("time"))
    nothing = asked.filter("want is null").crossJoin(F.broadcast(ends)).select("want", F.col("most").alias("time"))
    return found.union(nothing)


def nearest_site(points: DataFrame, sites: DataFrame, lowest_deg: float, reach_m: float) -> DataFrame:
    """(id, site, distance, covered, beam_m) of the nearest radar site; sites are some dozens.

    covered is null without a site, and beam_m is the height of the lowest beam within its reach only.
    """
    far = haversine(F.col("lon"), F.col("lat"), F.col("site_lon"), F.col("site_lat"))
    best = points.join(F.broadcast(sites), how="left").groupBy("id").agg(F.min(F.struct(far.alias("distance"), "site")).alias("m"))
    best = best.select("id", "m.site", "m.distance", (F.col("m.distance") <= reach_m).alias("covered"))
    return best.withColumn("beam_m", F.when(F.col("covered"), beam_height(F.col("distance"), F.lit(lowest_deg))))


def with_zones(areas: DataFrame, zones: DataFrame) -> DataFrame:
    """Areas (id, inline, scheme, code) with a geometry and where it is from: its own, else that of its zone code."""
    found = areas.join(zones.withColumnRenamed("geometry", "_zone"), ["scheme", "code"], "left")
    source = F.when(F.col("inline").isNotNull(), "inline").when(F.col("_zone").isNotNull(), "geocode")
    return found.select("id", F.coalesce("inline", "_zone").alias("geometry"), source.alias("provenance"))


def cells_in_areas(points_in: DataFrame, obs: DataFrame, start, end) -> DataFrame:
    """(area_id, station_id, parameter, n, first, last) of the series of stations in areas within a window; empty ones drop."""
    series = obs.filter(F.col("value").isNotNull() & F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    series = series.groupBy("station_id", "parameter").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))
    return points_in.join(series, "station_id").select("area_id", "station_id", "parameter", "n", "first", "last")


def reporting_locations(obs: DataFrame, registry: DataFrame) -> DataFrame:
    """(station_id, name, newest) of stations that report; the registry names those that it has, the others keep their id."""
    seen = obs.groupBy("station_id").agg(F.max("time").alias("newest"))
    return seen.join(registry.select("station_id", F.col("name").alias("_name")), "station_id", "left").select("station_id", F.coalesce("_name", F.col("station_id").cast("string")).alias("name"), "newest")


def top_reasons(terms: DataFrame, k: int = 3) -> DataFrame:
    """Of each id's terms (id, name, value) the k largest by absolute value, then name, in that order."""
    order = W.partitionBy("id").orderBy(F.abs("value").desc(), "name")
    return terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "rank", "name", "value")


def growth_class(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """(frame, label, growth) of cells (frame, label, volume): growing from the volume of the cell they are matched to on, else decaying; unknown without a match.

    matches has frame (the later one), label and was, the matched cell of the frame before.
    """
    before = cells.select((F.col("frame") + 1).alias("frame"), F.col("label").alias("was"), F.col("volume").alias("before"))
    met = cells.join(matches.select("frame", "label", "was").join(before, ["frame", "was"]), ["frame", "label"], "left")
    growth = F.when(F.col("before").isNull(), "unknown").when(F.col("volume") >= F.col("before"), "growing").otherwise("decaying")
    return met.select("frame", "label", growth.alias("growth"))


def history(cells: DataFrame, frames: int) -> DataFrame:
    """The last frames of each track, the newest first (place 1)."""
    return cells.withColumn("place", F.row_number().over(W.partitionBy("track").orderBy(F.desc("frame")))).filter(F.col("place") <= frames)


def damped_growth(tendency: Column, lead: Column, efold: float) -> Column:
    """A tendency carried on over a lead while it dies away."""
    return tendency * efold * (1 - F.exp(-lead / efold))


def turned_wind(u: Column, v: Column, gamma_deg: Column) -> tuple[Column, Column]:
    """Grid-relative components turned by the convergence, to the east and to the north."""
    c, s = F.cos(F.radians(gamma_deg)), F.sin(F.radians(gamma_deg))
    return u * c + v * s, v * c - u * s


def canonical_unit(unit: Column) -> Column:
    """One spelling of products of powers: factors in order with plain exponents, as `kg m-2 s-1`."""
    text = F.regexp_replace(F.trim(unit), r"\*\*|\^", "")
    text = F.regexp_replace(text, r"[.·*]\s*(?=[A-Za-z])", " ")
    text = F.regexp_replace(text, r"\s*/\s*([A-Za-z]+)(\d*)", " $1-$2")
    text = F.regexp_replace(text, r"([A-Za-z])-(?=\s|$)", "$1-1")
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def shown(values: DataFrame) -> DataFrame:
    """values (unit, value) with shown_unit and shown_value; units without a rule stay as they are."""
    rules = F.broadcast(values.sparkSession.createDataFrame(DISPLAY, "unit string, to string, scale double, offset double"))
    out = values.join(rules, "unit", "left")
    return out.withColumn("shown_value", F.coalesce(F.col("value") * F.col("scale") + F.col("offset"), "value")).withColumn("shown_unit", F.coalesce("to", "unit")).drop("to", "scale", "offset")


def severity_code(text: Column) -> Column:
    """0 (unknown) to 4."""
    key = F.lower(F.trim(text))
    out = F.lit(0)
    for name, code in SEVERITY.items():
        out = F.when(key == name, code).otherwise(out)
    return out


def likely_clutter(speed_ms: Column, age: Column, net_km: Column, slow: float = 3.0, old: int = 6, near: float = 3.0) -> Column:
    """Slow and old. Known to have travelled over near, it is no clutter; an unknown displacement decides nothing, an unknown speed is no clutter."""
    return F.when(net_km > near, F.lit(False)).otherwise(F.coalesce((speed_ms < slow) & (age >= old), F.lit(False)))


def log_weight(raw: Column, low: float = 100.0, high: float = 700_000.0) -> Column:
    """0 at low and below to 1 at high and above, even in the logarithm of one more; what isn't a positive number weighs nothing."""
    share = (F.log10(raw + 1) - F.log10(F.lit(low + 1))) / (F.log10(F.lit(high + 1)) - F.log10(F.lit(low + 1)))
    known = raw.isNotNull() & ~F.isnan(raw) & (raw > 0) & (raw < float("inf"))
    return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0)


def alert_window(onset: Column, effective: Column, sent: Column, expires: Column, ttl: str) -> tuple[Column, Column]:
    """Start and end: onset, effective or sent; expires, or ttl after the start."""
    start = F.coalesce(onset, effective, sent)
    return start, F.coalesce(expires, start + F.expr(f"interval {ttl}"))


def feature_id(sender: Column, identifier: Column, info: Column, area: Column) -> Column:
    """An id with the sender's length in bytes before it, so that no two differ only by where the sender ends; a null sender is empty."""
    sender = F.coalesce(sender, F.lit(""))
    head = F.concat(F.lit("cap:"), F.octet_length(sender).cast("string"), F.lit(":"), sender, identifier)
    return F.concat(head, F.lit("."), info.cast("string"), F.lit("."), area.cast("string"))


def pixel_of(lon: Column, lat: Column, west: float, north: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Column and row of the pixel that holds a point of a grid whose first row is the northern one."""
    return F.floor((lon - west) / dx).cast("int"), F.floor((north - lat) / dy).cast("int")


def cf_time(value: Column, units: Column) -> Column:
    """An instant of `seconds|minutes|hours|days since YYYY-MM-DD[ hh:mm:ss]`; null if the units are none of these."""
    pattern = r"^(second|minute|hour|day)s? since (\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}:\d{2}))?"
    unit = F.regexp_extract(units, pattern, 1)
    size = F.when(unit == "second", 1).when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400)
    clock = F.regexp_extract(units, pattern, 3)
    epoch = F.try_to_timestamp(F.concat(F.regexp_extract(units, pattern, 2), F.lit(" "), F.when(clock == "", "00:00:00").otherwise(clock)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.timestamp_micros(F.unix_micros(epoch) + F.round(value * size * 1e6).cast("long")).cast("timestamp_ntz")
