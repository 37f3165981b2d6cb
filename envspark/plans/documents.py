"""Queries that write rows of the tables as the texts of a source and read them back, and queries over scored cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.operators import ingest, significance
from envspark.plans.registry import query, rounded
from envspark.sources import documents
from envspark.streaming import states


def _text(time: str, offset: str = "Z"):
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


@query("obs stations", """SELECT CAST(station_id AS VARCHAR) AS location, lat, lon, epoch_us(time) // 1000000 - 7200 AS epoch_s, p AS parameter,
 CASE WHEN parameter = p THEN value END AS value FROM obs JOIN stations USING (station_id), (SELECT unnest(['click', 'view']) AS p)""")
def src_station_csv(obs, stations):
    value = lambda p: F.when(F.col("parameter") == p, F.col("value").cast("string")).otherwise("-").alias(p)
    table = obs.join(stations, "station_id").select(F.col("station_id").cast("string").alias("name"), "lat", "lon", _text("time", "+0200").alias("when"), value("click"), value("view"))
    return documents.station_rows(table).withColumn("epoch_s", F.unix_seconds("time")).drop("time")


@query("obs stations", """SELECT CAST(station_id AS VARCHAR) AS location, count(value) AS n, round(sum(value), 3) AS total, min(lon) AS lon, min(lat) AS lat
 FROM obs JOIN stations USING (station_id) WHERE parameter = 'view' GROUP BY 1""")
def sink_station_geojson(obs, stations):
    rows = obs.join(stations, "station_id").withColumnRenamed("station_id", "location").withColumn("location", F.col("location").cast("string"))
    texts = documents.station_features(rows.withColumn("time", F.col("time").cast("timestamp")))
    schema = "id string, geometry struct<coordinates array<double>>, properties struct<series map<string, array<struct<t long, v double>>>>"
    read = texts.select(F.from_json("value", schema).alias("f"))
    view = F.filter(F.col("f.properties.series")["view"], lambda x: x["v"].isNotNull())
    out = read.filter(F.col("f.properties.series")["view"].isNotNull()).select(
        F.col("f.id").alias("location"), F.size(view).cast("long").alias("n"), F.aggregate(view, F.lit(0.0), lambda a, x: a + x["v"]).alias("total"),
        F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"),
    )
    return rounded(out, "total", digits=3)


@query("notifications", """SELECT 'fi-centre' AS centre_id, CAST(id AS VARCHAR) AS id, data_id, epoch_us(pubtime) // 1000000 AS epoch_s, is_deletion,
 CASE WHEN is_deletion THEN NULL ELSE 'https://host/' || data_id END AS link FROM notifications""")
def src_notifications(notifications):
    link = F.struct(F.when(F.col("is_deletion"), "deletion").otherwise(" Canonical ").alias("rel"), F.concat(F.lit("https://host/"), "data_id").alias("href"))
    payload = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("id").cast("string").alias("id"), F.lit("v04").alias("version"),
        F.struct("data_id", _text("pubtime").alias("pubtime")).alias("properties"), F.array(link).alias("links"),
    ))
    read = documents.notifications(notifications.select(F.lit("cache/a/wis2/fi-centre/data").alias("topic"), payload.alias("payload")))
    return read.select("centre_id", "id", "data_id", F.unix_seconds("pubtime").alias("epoch_s"), "is_deletion", "link")


@query("run_acc", """, m AS (SELECT strftime(run_time, '%Y%m%d%H') AS file, cell * 24 + step AS record, (cell * 24 + step) * 100 AS place, cell, step FROM run_acc)
 SELECT file, record, place AS "offset", coalesce(lead(place) OVER (PARTITION BY file ORDER BY place) - place, -1) AS length, 'cell ' || cell AS level, CAST(step AS INT) AS step,
 CASE WHEN step = 0 OR cell % 2 = 0 THEN 'instant' ELSE 'acc' END AS kind, CASE WHEN step = 0 OR cell % 2 = 0 THEN -1 ELSE 0 END AS window_start FROM m""")
def src_index_wgrib2(run_acc):
    record = F.col("cell") * 24 + F.col("step")
    step = F.when(F.col("step") == 0, "anl").when(F.col("cell") % 2 == 0, F.concat("step", F.lit(" hour fcst"))).otherwise(F.concat(F.lit("0-"), "step", F.lit(" hour acc fcst")))
    run = F.date_format("run_time", "yyyyMMddHH")
    line = F.concat_ws(":", record, record * 100, F.concat(F.lit("d="), run), F.lit("APCP"), F.concat(F.lit("cell "), "cell"), step, F.lit(""))
    found = documents.message_index(run_acc.select(run.alias("file"), line.alias("value")))
    return found.drop("reference", "parameter").withColumn("record", F.col("record").cast("long")).fillna(-1, ["length", "window_start"])


@query("run_acc", """, m AS (SELECT strftime(run_time, '%Y%m%d') AS file, run_time, cell, step, row_number() OVER (PARTITION BY run_time ORDER BY cell, step) AS k FROM run_acc WHERE cell % 7 <> 6)
 SELECT file, CAST(epoch(run_time) AS BIGINT) AS reference_s, CAST(first_value(step) OVER (PARTITION BY file ORDER BY k) AS INTEGER) AS step, 'p' || (cell % 5) AS parameter, CASE WHEN cell % 2 = 0 THEN 'pl' ELSE 'sfc' END AS levtype,
 CAST(CASE WHEN cell % 2 = 0 THEN cell * 10 ELSE -1 END AS INTEGER) AS level, CAST(step * 1000 + cell AS BIGINT) AS "offset", CAST(cell + 1 AS BIGINT) AS length FROM m""")
def src_index_json(run_acc):
    """Index lines, some of them cut off and some without a level."""
    text = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    line = F.concat(
        F.lit('{"domain": "g", "date": "'), F.date_format("run_time", "yyyyMMdd"), F.lit('", "time": "'), F.date_format("run_time", "HHmm"), F.lit('", "step": '), text("step"),
        F.when(F.col("cell") % 2 == 0, F.concat(F.lit(', "levelist": "'), (F.col("cell") * 10).cast("string"), F.lit('", "levtype": "pl"'))).otherwise(F.lit(', "levtype": "sfc"')),
        F.lit(', "param": "p'), (F.col("cell") % 5).cast("string"), F.lit('", "_offset": '), (F.col("step") * 1000 + F.col("cell")).cast("string"), F.lit(', "_length": '), (F.col("cell") + 1).cast("string"), F.lit("}"))
    cut = F.when(F.col("cell") % 7 == 6, F.substring(line, 1, 40)).otherwise(line)
    found = documents.json_index(run_acc.select(F.date_format("run_time", "yyyyMMdd").alias("file"), F.struct("cell", "step").alias("place"), cut.alias("value")))
    return found.withColumn("reference_s", F.unix_seconds("reference")).drop("reference").fillna(-1, "level")


@query("areas", "SELECT CAST(area_id AS VARCHAR) AS id, name, 'Polygon' AS geometry_type, west, north FROM areas")
def src_features_geojson(areas):
    ring = F.array(*[F.array(x, y) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("area_id").cast("string").alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("name").alias("properties"),
    )
    texts = areas.groupBy("south").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    out = documents.features(texts).withColumn("ring", F.from_json("coordinates", "array<array<array<double>>>")[0])
    return out.select("id", F.col("properties")["name"].alias("name"), "geometry_type", F.array_min(F.transform("ring", lambda p: p[0])).alias("west"), F.array_max(F.transform("ring", lambda p: p[1])).alias("north"))


@query("alerts", """SELECT sender, identifier, epoch_us(sent) // 1000000 AS start_s, epoch_us(sent) // 1000000 + 3600 AS end_s, msg_type, CAST(severity AS VARCHAR) AS severity, a AS area,
 CASE a WHEN 0 THEN 'first' ELSE 'second' END AS area_desc FROM alerts, (SELECT unnest([0, 1]) AS a)""")
def src_cap(alerts):
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    area = lambda name: F.lit(f"<area><areaDesc>{name}</areaDesc><polygon>60,20 61,20 61,21 60,20</polygon></area>")
    end = F.concat(F.date_format(F.col("sent") + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-00:00"))
    info = tag("info", F.concat(tag("severity", F.col("severity").cast("string")), tag("effective", _text("sent")), tag("expires", end), area("first"), area("second")))
    value = tag("alert", F.concat(tag("identifier", F.col("identifier")), tag("sender", F.col("sender")), tag("sent", _text("sent")), tag("msgType", F.col("msg_type")), info))
    out = documents.alerts(alerts.select(value.alias("value")))
    return out.select("sender", "identifier", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "msg_type", "severity", "area", "area_desc")


_NEWS = """ n{k} AS (SELECT *, NOT taken AND coalesce(pubtime > max(CASE WHEN NOT taken THEN pubtime END) OVER (PARTITION BY data_id ORDER BY received, id, pubtime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS passes
  FROM (SELECT id, data_id, pubtime, is_deletion, received, {taken} AS taken FROM {of}))"""
_TAKEN = "coalesce(bool_or(passes) OVER (PARTITION BY id ORDER BY received, id, pubtime, data_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"


#: Two messages of different data_ids have one id; who takes it is settled in as many rounds as the SQL has.
@query("notifications", ", n AS (SELECT id // 2 AS id, data_id, pubtime, is_deletion, (id * 7919) % 10007 AS received FROM notifications)," + ",".join(
    _NEWS.format(k=k, taken=_TAKEN if k else "false", of=f"n{k - 1}" if k else "n") for k in range(9)) + " SELECT id, data_id, pubtime, is_deletion FROM n8 WHERE passes")
def st_dedup(notifications):
    rows = notifications.withColumns({"received": F.col("id") * 7919 % 10007, "id": F.floor(F.col("id") / 2)})
    return ingest.only_news(rows, "received").drop("received")


_ALERTS = """, m AS (SELECT *, sender || '/' || (CAST(substr(identifier, 2) AS INT) % 50) AS data_id, msg_type = 'Cancel' AND severity = 0 AS deletion FROM alerts),
 win AS (SELECT DISTINCT sender, identifier, sent, data_id FROM (SELECT *, rank() OVER (PARTITION BY sender, identifier ORDER BY sent DESC, data_id DESC) AS k FROM m WHERE NOT deletion AND msg_type IN ('Alert', 'Update')) WHERE k = 1),
 del AS (SELECT data_id, max(sent + INTERVAL 1 DAY) AS until FROM m WHERE deletion GROUP BY 1),
 wd AS (SELECT ref_sender AS sender, ref_identifier AS identifier, ref_sent AS sent, sent AS until FROM m WHERE NOT deletion AND msg_type IN ('Update', 'Cancel') AND ref_sender IS NOT NULL
  UNION ALL SELECT m.sender, m.identifier, m.sent, d.until FROM m JOIN del d ON d.data_id = m.data_id AND m.sent <= d.until WHERE NOT deletion)"""


@query("alerts", f"{_ALERTS} SELECT sender, identifier, sent, data_id FROM win w WHERE NOT EXISTS (SELECT 1 FROM wd WHERE wd.sender = w.sender AND wd.identifier = w.identifier AND wd.sent = w.sent AND w.sent <= wd.until) AND NOT EXISTS (SELECT 1 FROM del WHERE del.data_id = w.data_id AND w.sent <= del.until)")
def st_alert_accumulator(alerts):
    return states.held_alerts(states.alert_fold(10**9)(None, _messages(alerts))).select("sender", "identifier", F.col("sent").cast("timestamp_ntz").alias("sent"), "data_id")


def _messages(alerts):
    sent = lambda c: F.col(c).cast("timestamp")
    deletion = (F.col("msg_type") == "Cancel") & F.coalesce(F.col("severity") == 0, F.lit(False))
    reference = F.struct(F.col("ref_sender").alias("sender"), F.col("ref_identifier").alias("identifier"), sent("ref_sent").alias("sent"))
    return alerts.select(
        F.concat("sender", F.lit("/"), (F.substring("identifier", 2, 9).cast("int") % 50).cast("string")).alias("data_id"), F.when(deletion, sent("sent") + F.expr("interval 1 day")).otherwise(sent("sent")).alias("pubtime"), deletion.alias("deletion"),
        "sender", "identifier", sent("sent").alias("sent"), "msg_type", (sent("sent") + F.expr("interval 6 hours")).alias("expires"), "severity",
        F.when(F.col("ref_sender").isNotNull(), F.array(reference)).otherwise(F.array().cast("array<struct<sender:string,identifier:string,sent:timestamp>>")).alias("references"))


@query("obs", """, v AS (SELECT station_id AS cell, time, max(value) AS value FROM obs WHERE value IS NOT NULL GROUP BY 1, 2), e AS (SELECT max(time) AS last FROM v)
 SELECT cell, round(sum(value), 5) AS value, count(*) AS n FROM v, e WHERE time > last - INTERVAL 2 DAY GROUP BY 1""")
def st_period_rolling(obs):
    rows = obs.select(F.col("station_id").alias("cell"), "time", "value")
    return rounded(states.rolling_fold(2 * 86400)(None, rows).filter("kind = 'sum'").select("cell", "value", "n"), "value")


_CELLS = """, c AS (SELECT frame, row_idx, max(value) AS top, count(*) FILTER (value >= 25) AS n FROM frames GROUP BY 1, 2),
 t AS (SELECT *, greatest(0, least(1, (top - 20) / 25)) AS dbz, CASE WHEN n > 0 THEN least(1, n / 10) END AS area, CASE WHEN row_idx % 2 = 0 THEN 1 ELSE 0 END AS mover, CASE WHEN n < 5 THEN 0.5 ELSE 0 END AS clutter FROM c),
 m AS (SELECT *, CASE WHEN area IS NULL THEN 0.4 ELSE 0.7 END AS mass, (0.4 * dbz + 0.3 * coalesce(area, 0)) / CASE WHEN area IS NULL THEN 0.4 ELSE 0.7 END AS mean FROM t),
 s AS (SELECT *, (mean + (1 - mean) * 0.2 * mover / mass) * (1 - 0.9 * clutter) AS score FROM m)"""


def _scored(frames):
    cells = frames.groupBy("frame", "row_idx").agg(F.max("value").alias("top"), F.count_if(F.col("value") >= 25).alias("n"))
    return significance.score(cells, [
        significance.term("max_dbz", 0.4, (F.col("top") - 20) / 25),
        significance.term("area", 0.3, F.when(F.col("n") > 0, F.col("n") / 10)),
        significance.term("deviant_mover", 0.2, F.when(F.col("row_idx") % 2 == 0, 1.0).otherwise(0.0), bonus=True),
        significance.term("clutter", -0.9, F.when(F.col("n") < 5, 0.5).otherwise(0.0), bonus=True),
    ])


@query("frames", f"{_CELLS} SELECT frame, row_idx, round(score, 5) AS score FROM s")
def fn_significance(frames):
    return rounded(_scored(frames), "score").select("frame", "row_idx", "score")


@query("frames", f"{_CELLS} SELECT frame, row_idx, score FROM (SELECT frame, row_idx, round(score, 5) AS score FROM s) ORDER BY score DESC, frame * 100 + row_idx LIMIT 25")
def nc_score(frames):
    scored = rounded(_scored(frames), "score").withColumn("cell", F.col("frame") * 100 + F.col("row_idx"))
    return significance.most_significant(scored, 25, "cell").select("frame", "row_idx", "score")
