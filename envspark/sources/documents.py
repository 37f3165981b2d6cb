"""Texts to tables: station files, notifications, message indexes, feature collections and alert documents; and two sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.operators.grids import dealt

NOTIFICATION = """type string, id string, conformsTo array<string>, version string, properties map<string, string>,
 links array<struct<rel string, href string>>"""
COLLECTION = "type string, features array<struct<id string, geometry struct<type string, coordinates string>, properties map<string, string>>>"
ALERT = """identifier string, sender string, sent string, status string, msgType string, references string,
 info array<struct<language string, event string, severity string, onset string, effective string, expires string, headline string,
  area array<struct<areaDesc string, polygon array<string>, circle array<string>, geocode array<struct<valueName string, value string>>>>>>"""
_MOMENT = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|UTC|[+-]\d\d:?\d\d)$"


def moment(text: Column) -> Column:
    """The instant of a date and time with its offset; null where there is no offset, as it is never guessed."""
    text = F.regexp_replace(F.trim(text), " (Z|UTC|[+-])", "$1")
    plain = F.regexp_replace(F.regexp_replace(text, "UTC$", "Z"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(text.rlike(_MOMENT), plain.try_cast("timestamp"))


def _needed(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"a row has no valid {what}")))


def station_rows(table: DataFrame) -> DataFrame:
    """(location, lat, lon, time, parameter, value) of a table of texts.

    Its first four columns are location, latitude, longitude and time, whatever their names; every other is a parameter. What isn't a
    number becomes a null value; a bad coordinate, or a time without an offset, fails the load.
    """
    names = table.columns
    if len(names) < 4:
        raise ValueError("a station file has location, latitude, longitude and time")
    numbers = [F.col(f"`{n}`").try_cast("double") for n in names[1:3]]
    fixed = [F.col(f"`{names[0]}`").alias("location"), _needed(numbers[0], "latitude").alias("lat"), _needed(numbers[1], "longitude").alias("lon")]
    fixed.append(_needed(moment(F.col(f"`{names[3]}`")), "time").alias("time"))
    series = [F.struct(F.lit(n).alias("parameter"), F.trim(F.col(f"`{n}`")).try_cast("double").alias("value")) for n in names[4:]]
    if not series:
        return table.select(*fixed, F.lit("").alias("parameter"), F.lit(None).cast("double").alias("value")).filter(F.lit(False))
    return table.select(*fixed, F.inline(F.array(*series)))


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    """station_rows of files with a head line; a row with another number of fields fails the load."""
    return station_rows(spark.read.csv(path, header=True, mode="FAILFAST", inferSchema=False))


def write_station_csv(observations: DataFrame, path: str) -> None:
    """(location, lat, lon, time, parameter, value) as files with one row for each location, time and parameter."""
    time = F.date_format(F.to_utc_timestamp("time", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    observations.select("location", "lat", "lon", time.alias("time"), "parameter", "value").write.csv(path, header=True)


def station_features(observations: DataFrame) -> DataFrame:
    """One feature, as JSON text, for each location of (location, lat, lon, time, parameter, value), with its series in order of time.

    The series of one location is gathered in one row, so its length has to fit one.
    """
    point = F.struct(F.unix_seconds("time").alias("t"), F.col("value").alias("v"))
    series = observations.groupBy("location", "parameter").agg(
        F.min(F.struct("time", "lat", "lon")).alias("first"), F.array_sort(F.collect_list(point)).alias("series")
    )
    each = series.groupBy("location").agg(F.min("first").alias("first"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", "series")))).alias("series"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("first.lon", "first.lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("location").alias("id"), geometry.alias("geometry"), F.struct("series").alias("properties"))
    return each.select("location", F.to_json(feature).alias("value"))


def notifications(messages: DataFrame) -> DataFrame:
    """Typed columns of messages (topic, payload).

    A payload counts if it is a feature of the first version of its standard (or the older "v04") with id, data_id and pubtime. The link
    is the first of rel canonical, else of rel update; a link of rel deletion announces a removal. Other properties stay in extras.
    """
    m = messages.select("topic", F.from_json("payload", NOTIFICATION).alias("m")).select("topic", "m.*")
    named = lambda key: F.nullif(F.trim(F.col("properties")[key]), F.lit(""))
    rel = lambda link: F.lower(F.trim(F.coalesce(link["rel"], F.lit(""))))
    links = F.filter(F.coalesce("links", F.array()), lambda x: F.length(F.trim(x["href"])) > 0)
    of = lambda kind: F.get(F.filter(links, lambda x: rel(x) == kind), F.lit(0))
    parts = F.split("topic", "/")
    place = lambda i: F.get(parts, F.lit(i))
    known = F.exists(F.coalesce("conformsTo", F.array()), lambda c: c.contains("wis.wmo.int/spec/wnm/1")) | F.coalesce(F.col("version") == "v04", F.lit(False))
    out = m.filter((F.col("type") == "Feature") & known & (F.length("id") > 0)).select(
        "topic",
        F.when(place(0).isin("cache", "origin") & (place(2) == "wis2"), F.nullif(place(3), F.lit(""))).alias("centre_id"),
        "id",
        named("data_id").alias("data_id"),
        moment(F.col("properties")["pubtime"]).alias("pubtime"),
        F.exists(links, lambda x: rel(x) == "deletion").alias("is_deletion"),
        F.trim(F.coalesce(of("canonical"), of("update"))["href"]).alias("link"),
        F.map_filter("properties", lambda k, v: ~k.isin("data_id", "pubtime")).alias("extras"),
    )
    return out.filter(F.col("data_id").isNotNull() & F.col("pubtime").isNotNull())


def message_index(lines: DataFrame) -> DataFrame:
    """Catalogue of messages from index lines (file, value): record:offset:d=YYYYMMDDHH:parameter:level:step.

    A message ends where the next record of its file begins, one that isn't understood included; the last has no length. Files with
    more than one reference time give nothing. Steps: analysis, hours, minutes, and hour windows of max, min, acc and ave.
    """
    line = F.trim("value")
    part = lambda i: F.trim(F.get(F.split(line, ":", 6), F.lit(i)))
    step = F.lower(F.trim(F.regexp_replace(part(5), ":+$", "")))
    rows = lines.filter(~line.startswith("#")).select(
        "file", part(0).try_cast("int").alias("record"), part(1).try_cast("long").alias("offset"), part(3).alias("parameter"), part(4).alias("level"), step.alias("said"),
        F.when(part(2).rlike(r"^d=\d{10}$"), F.try_to_timestamp(F.concat(F.substring(part(2), 3, 10), F.lit("0000 +0000")), F.lit("yyyyMMddHHmmss Z"))).alias("reference"),
    ).filter(F.col("record").isNotNull() & F.col("offset").isNotNull())
    found = lambda pattern, group: F.regexp_extract("said", pattern, group)
    window, hours, minutes = r"^(\d+) *- *(\d+) hour (max|min|acc|ave) fcst$", r"^(\d+) hour fcst$", r"^(\d+) min fcst$"
    start, end = found(window, 1).try_cast("int"), found(window, 2).try_cast("int")
    whole = F.when(F.col("said") == "anl", 0).when(F.col("said").rlike(hours), found(hours, 1).try_cast("int"))
    rows = rows.withColumns({
        "window_start": start,
        "step": F.coalesce(end, whole, F.floor(found(minutes, 1).try_cast("int") / 60)).cast("int"),
        "kind": F.when(start.isNotNull(), found(window, 3)).otherwise("instant"),
        "next": F.min("offset").over(W.partitionBy("file").orderBy("offset").rangeBetween(1, W.unboundedFollowing)),
    })
    one = W.partitionBy("file")
    usable = F.col("step").isNotNull() & F.col("reference").isNotNull() & (~F.col("kind").isin("acc", "ave") | (F.col("window_start") < F.col("step")))
    rows = rows.filter(usable).withColumn("_single", F.min("reference").over(one) == F.max("reference").over(one)).filter("_single")
    return rows.select("file", "record", "offset", (F.col("next") - F.col("offset")).alias("length"), "reference", "parameter", "level", "step", "kind", "window_start")


#: The names of an index line.
INDEX_LINE = "date string, time string, step string, levelist string, levtype string, param string, _offset long, _length long"


def json_index(lines: DataFrame) -> DataFrame:
    """(file, reference, step, parameter, levtype, level, offset, length) of the messages of JSON index lines (file, place, value).

    A file's first readable line gives its reference time and step (0 if it isn't a number); place orders its lines. Lines that aren't
    JSON or lack param, levtype, _offset or _length are left out, and so is a file whose reference time can't be read. A level that is no
    whole number is null.
    """
    rows = lines.filter(F.length(F.trim("value")) > 0).select("file", "place", F.from_json(F.trim("value"), INDEX_LINE).alias("m"))
    rows = rows.filter("m.date is not null and m.time is not null and m.param is not null and m.levtype is not null and m._offset is not null and m._length is not null and m.step is not null")
    head = rows.groupBy("file").agg(F.min_by(F.struct("m.date", "m.time", "m.step"), "place").alias("h"))
    valid = F.col("h.date").rlike(r"^\d{8}$") & F.col("h.time").rlike(r"^\d{4}$")
    reference = F.when(valid, F.try_to_timestamp(F.concat("h.date", "h.time", F.lit(" +0000")), F.lit("yyyyMMddHHmm Z")))
    head = head.select("file", reference.alias("reference"), F.coalesce(F.col("h.step").try_cast("int"), F.lit(0)).alias("step")).filter("reference is not null")
    return rows.join(head, "file").select("file", "reference", "step", F.col("m.param").alias("parameter"), "m.levtype", F.when(F.col("m.levelist").rlike(r"^\d+$"), F.col("m.levelist").try_cast("int")).alias("level"), F.col("m._offset").alias("offset"), F.col("m._length").alias("length"))


def features(collections: DataFrame) -> DataFrame:
    """(ordinal, id, geometry_type, coordinates as JSON text, properties) of each feature of feature collections (value)."""
    parsed = collections.select(F.from_json("value", COLLECTION).alias("c")).filter("c.type = 'FeatureCollection'")
    each = parsed.select(F.posexplode("c.features").alias("ordinal", "f"))
    return each.select("ordinal", "f.id", F.col("f.geometry.type").alias("geometry_type"), "f.geometry.coordinates", "f.properties")


def alerts(documents: DataFrame) -> DataFrame:
    """One row for each area of each info of alert documents (value, as XML), with the window in which it holds.

    The window begins at onset, else at effective, else at sent. Documents without an identifier, sender or valid sent time are left out.
    """
    # texts are dealt over all tasks; the generator keeps filters on the parts from reading a text again for each
    a = dealt(documents.select("value")).select(F.explode(F.array(F.from_xml("value", ALERT))).alias("a")).select("a.*").withColumn("sent", moment(F.col("sent")))
    a = a.filter(F.col("identifier").isNotNull() & F.col("sender").isNotNull() & F.col("sent").isNotNull())
    i = a.select("sender", "identifier", "sent", "status", "msgType", "references", F.posexplode("info").alias("info", "i"))
    out = i.select("*", F.posexplode("i.area").alias("area", "r"))
    start = F.coalesce(moment(F.col("i.onset")), moment(F.col("i.effective")), F.col("sent"))
    return out.select(
        "sender", "identifier", "sent", "status", F.col("msgType").alias("msg_type"), "references", "info", "area", "i.language", "i.event", "i.severity", "i.headline",
        start.alias("start"), moment(F.col("i.expires")).alias("end"), F.col("r.areaDesc").alias("area_desc"), "r.polygon", "r.circle", "r.geocode",
    )
