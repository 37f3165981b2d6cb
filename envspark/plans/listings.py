"""Registered queries over report elements and file names, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.plans.registry import half_up, query
from envspark.sources import catalog, reports

#: Events as elements: a report a station and quarter of a day; every third report of a station lies 0.02 degrees off.
_ELEMENTS = """SELECT station_id, date_trunc('day', time) AS time, CAST(hour(time) AS INT) // 6 AS report, seq AS ord, 20 + station_id * 0.1e0 AS lon,
 60 + CASE WHEN (station_id + CAST(hour(time) AS INT) // 6) % 3 = 0 THEN 0.02e0 ELSE 0e0 END AS lat, CASE WHEN seq % 4 > 0 THEN (seq % 90) * 1.0e0 END AS elevation,
 CASE parameter WHEN 'click' THEN '012101' WHEN 'view' THEN '012104' WHEN 'purchase' THEN '013011' WHEN 'error' THEN '010004' ELSE '011002' END AS code, value, CASE seq % 3 WHEN 0 THEN 12e0 WHEN 1 THEN 24.2e0 END AS period_hours FROM obs"""
RULES = [reports.Rule("temperature", ("012101", "012104"), offset=-273.15), reports.Rule("rain_24h", ("013011",), 24.0), reports.Rule("rain_12h", ("013011", "011002"), 12.0), reports.Rule("pressure", ("010004",), scale=0.01)]
_EXTRACT = f""", x AS ({_ELEMENTS}), p AS (SELECT station_id, time, list_reduce(list(struct_pack(report, lon, lat) ORDER BY report), lambda a, b: CASE WHEN abs(a.lat - b.lat) <= 0.01 AND abs(a.lon - b.lon) <= 0.01 THEN a ELSE b END) AS f FROM (SELECT DISTINCT station_id, time, report, lon, lat FROM x) GROUP BY 1, 2),
 k AS (SELECT x.*, f FROM x JOIN p USING (station_id, time) WHERE report >= f.report)
 SELECT station_id, time, any_value(f.lon) AS lon, any_value(f.lat) AS lat, arg_min(elevation, (report, ord)) FILTER (elevation IS NOT NULL) AS elevation,
 floor((arg_min(value, (code, report, ord)) FILTER (code IN ('012101', '012104') AND value IS NOT NULL) - 273.15) * 10000.0 + 0.5) / 10000.0 AS temperature,
 floor((arg_min(value, (report, ord)) FILTER (code = '013011' AND abs(period_hours - 24) < 0.25 AND value IS NOT NULL)) * 10000.0 + 0.5) / 10000.0 AS rain_24h,
 floor((arg_min(value, (-CAST(code AS INT), report, ord)) FILTER (code IN ('013011', '011002') AND abs(period_hours - 12) < 0.25 AND value IS NOT NULL)) * 10000.0 + 0.5) / 10000.0 AS rain_12h,
 floor((arg_min(value, (report, ord)) FILTER (code = '010004' AND value IS NOT NULL) * 0.01) * 10000.0 + 0.5) / 10000.0 AS pressure FROM k GROUP BY 1, 2"""


@query("obs", _EXTRACT)
def src_report_extract(obs):
    hour = F.floor(F.hour("time") / 6)
    code = F.coalesce(*[F.when(F.col("parameter") == p, F.lit(c)) for p, c in (("click", "012101"), ("view", "012104"), ("purchase", "013011"), ("error", "010004"))], F.lit("011002"))
    elements = obs.select(
        "station_id", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time"), hour.alias("report"), F.col("seq").alias("ord"), (20 + F.col("station_id") * 0.1).alias("lon"), (60 + F.when((F.col("station_id") + hour) % 3 == 0, 0.02).otherwise(0.0)).alias("lat"),
        F.when(F.col("seq") % 4 > 0, (F.col("seq") % 90).cast("double")).alias("elevation"), code.alias("code"), "value", F.when(F.col("seq") % 3 == 0, 12.0).when(F.col("seq") % 3 == 1, 24.2).alias("period_hours"))
    return half_up(reports.extract(elements, RULES), *[r.parameter for r in RULES])


#: Events as files of a model's runs; some unfinished, hidden, of a thirteenth month, or listed below two prefixes.
_STAMP = "CAST(CAST(year(time) AS INT) AS VARCHAR(4)) || lpad(CAST(CASE WHEN seq % 19 = 0 THEN 13 ELSE CAST(month(time) AS INT) END AS VARCHAR(2)), 2, '0') || lpad(CAST(CAST(day(time) AS INT) AS VARCHAR(2)), 2, '0') || 'T' || lpad(CAST(CAST(hour(time) AS INT) AS VARCHAR(2)), 2, '0')"
_FILES = f"CAST(station_id AS VARCHAR(20)) || '/' || CASE WHEN seq % 17 = 0 THEN '.' ELSE '' END || 'run_' || lpad(CAST(seq % 67 AS VARCHAR(2)), 2, '0') || '_' || {_STAMP} || 'Z.nc' || CASE WHEN seq % 13 = 0 THEN '.part' ELSE '' END"


@query("obs", f""", f AS (SELECT {_FILES} AS key, seq % 1000 AS bytes FROM obs), n AS (SELECT *, regexp_extract(key, '/run_([0-9]{{2}})_([0-9]{{8}}T[0-9]{{2}})Z\\.nc$', ['lead', 'stamp']) AS g FROM f),
 r AS (SELECT key, bytes, CAST(g.lead AS INT) AS lead, try_strptime(g.stamp, '%Y%m%dT%H') AS time FROM n WHERE g.stamp <> '' AND bytes <= 950), d AS (SELECT time, lead, max(key) AS key, arg_max(bytes, key) AS bytes FROM r WHERE time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' GROUP BY 1, 2)
 SELECT * FROM d WHERE time IN (SELECT DISTINCT time FROM d ORDER BY time DESC LIMIT 400)""")
def src_file_catalog(obs):
    files = obs.selectExpr(f"{_FILES} AS key", "seq % 1000 AS bytes", "seq")
    return catalog.catalog(files, "run_{lead}_%Y%m%dT{run}Z.nc", ["*.part", ".*"], "2024-01-03 00:00:00", "2024-01-28 00:00:00", 400, 950, "seq").select("time", "lead", "key", "bytes")
