"""More registered queries: parameters, levels, units, alerts, tracks and slices, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.functions import geo, weather
from envspark.operators import aggregates, features, sorts
from envspark.plans.registry import query, rounded

# ---------------------------------------------------------------- selections


@query("obs", """, a AS (SELECT parameter, min(seq) AS place FROM obs GROUP BY 1), r AS (SELECT min(seq) AS position, upper(parameter) AS name FROM obs GROUP BY 2 UNION ALL SELECT 0, 'click')
 SELECT min(r.position) AS position, a.parameter FROM r LEFT JOIN a ON lower(a.parameter) = lower(r.name) GROUP BY a.parameter""")
def sel_parameters(obs):
    have = obs.groupBy("parameter").agg(F.min("seq").alias("place"))
    fixed = obs.sparkSession.createDataFrame([(0, "click")], "position long, name string")
    asked = have.select(F.col("place").alias("position"), F.upper("parameter").alias("name")).union(fixed)
    return features.select_parameters(have, asked)


@query("gates", "SELECT site, elangle, count(*) AS n FROM gates WHERE elangle IN (2.0, 5.0, 8.0) GROUP BY 1, 2")
def flt_level(gates):
    return features.at_levels(gates, features.level_steps(2.0, 3.0, 2), "elangle").groupBy("site", "elangle").agg(F.count("*").alias("n"))


@query("gates", "SELECT site, elangle, count(*) AS n FROM gates WHERE elangle >= 3.5 GROUP BY 1, 2")
def flt_level_interval(gates):
    return features.between_levels(gates, 3.5, None, "elangle").groupBy("site", "elangle").agg(F.count("*").alias("n"))


@query("areas", "SELECT area_id, name FROM areas WHERE west <= 24.5 AND east >= 21 AND south <= 64 AND north >= 60")
def flt_geom_bbox(areas):
    return features.boxes_meeting(areas, 21, 60, 24.5, 64).select("area_id", "name")


@query("frames", "SELECT frame, row_idx, col_idx, CASE WHEN power(row_idx - 9.5, 2) + power(col_idx - 9.5, 2) <= 36 THEN value END AS value FROM frames")
def flt_cell_mask(frames):
    inside = F.pow(F.col("row_idx") - 9.5, F.lit(2)) + F.pow(F.col("col_idx") - 9.5, F.lit(2)) <= 36
    return features.masked_cells(frames, inside).select("frame", "row_idx", "col_idx", "value")


@query("obs", """, i AS (SELECT station_id AS alert, seq AS ordinal, CASE parameter WHEN 'click' THEN CASE WHEN seq % 2 = 0 THEN 'fi-FI' ELSE ' FI_fi' END WHEN 'view' THEN 'SV' ELSE 'en' END AS lang FROM obs)
 SELECT alert, ordinal, lang FROM (SELECT *, max(CASE WHEN fi THEN 1 ELSE 0 END) OVER (PARTITION BY alert) AS has, min(ordinal) OVER (PARTITION BY alert) AS head
  FROM (SELECT *, lower(split_part(replace(trim(lang), '_', '-'), '-', 1)) = 'fi' AS fi FROM i)) WHERE CASE WHEN has = 1 THEN fi ELSE ordinal = head END""")
def flt_alert_language(obs):
    lang = F.when(F.col("parameter") == "click", F.when(F.col("seq") % 2 == 0, "fi-FI").otherwise(" FI_fi")).when(F.col("parameter") == "view", "SV").otherwise("en")
    return features.one_language(obs.select(F.col("station_id").alias("alert"), F.col("seq").alias("ordinal"), lang.alias("lang")), "fi")


@query("obs", "SELECT parameter, count(*) FILTER (value < 60) AS below, count(*) FILTER (value >= 60) AS matching FROM obs GROUP BY 1")
def flt_min_significance(obs):
    return obs.groupBy("parameter").agg(F.count_if(F.col("value") < 60).alias("below"), F.count_if(F.col("value") >= 60).alias("matching"))


@query("alerts", "SELECT DISTINCT sender, identifier, sent FROM alerts WHERE sent <= TIMESTAMP '2024-01-20' AND sent >= TIMESTAMP '2024-01-10'")
def flt_overlaps(alerts):
    from envspark.operators import filters

    until = lambda t: F.lit(t).cast("timestamp_ntz")
    shown = alerts.select("sender", "identifier", "sent").distinct().withColumns({"start": F.col("sent"), "end": F.col("sent")})
    return filters.overlaps(shown, until("2024-01-10"), until("2024-01-20")).drop("start", "end")


# ---------------------------------------------------------------- joins


@query("obs strikes", """, t AS (SELECT DISTINCT time FROM obs WHERE parameter = 'view'), w AS (SELECT DISTINCT time AS want FROM strikes)
 SELECT want, coalesce(a.time, (SELECT min(time) FROM t)) AS time FROM w ASOF LEFT JOIN t a ON w.want >= a.time""")
def join_asof_grid_time(obs, strikes):
    return features.snap_time(strikes.select(F.col("time").alias("want")), obs.filter("parameter = 'view'").select("time"))


@query("areas stations obs", """, s AS (SELECT area_id, station_id FROM areas JOIN stations ON lon > west AND lon < east AND lat > south AND lat < north)
 SELECT area_id, station_id, parameter, count(*) AS n, min(time) AS first, max(time) AS last FROM s JOIN obs USING (station_id) WHERE value IS NOT NULL AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1, 2, 3""")
def join_area_stations(areas, stations, obs):
    inside = stations.join(F.broadcast(areas), (F.col("lon") > F.col("west")) & (F.col("lon") < F.col("east")) & (F.col("lat") > F.col("south")) & (F.col("lat") < F.col("north")))
    return features.cells_in_areas(inside.select("area_id", "station_id"), obs, "2024-01-05", "2024-01-12")


_SITES = [(1, 22.0, 60.5), (2, 25.0, 62.5), (3, 28.5, 66.0), (4, 30.0, 70.0)]


@query("strikes", f""", s AS (SELECT * FROM (VALUES {', '.join(map(str, _SITES))}) v(site, site_lon, site_lat)),
 d AS (SELECT id, site, 2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(site_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(site_lat)) * power(sin(radians(site_lon - lon) / 2), 2)))) AS d FROM strikes, s),
 m AS (SELECT id, min_by(site, (d, site)) AS site, min(d) AS distance FROM d GROUP BY 1)
 SELECT id, site, round(distance, 3) AS distance, distance <= 150000 AS covered, CASE WHEN distance <= 150000 THEN round(sqrt(distance * distance + power(6371000.0 * 4 / 3, 2) + 2 * 6371000.0 * 4 / 3 * distance * sin(radians(0.5))) - 6371000.0 * 4 / 3, 2) END AS beam_m FROM m""")
def join_nearest_radar(strikes):
    sites = strikes.sparkSession.createDataFrame(_SITES, "site int, site_lon double, site_lat double")
    return rounded(rounded(features.nearest_site(strikes, sites, 0.5, 150_000.0), "distance", digits=3), "beam_m", digits=2)


@query("stations areas", """, a AS (SELECT station_id AS id, CASE WHEN station_id % 3 = 0 THEN 'own ' || station_id END AS inline, 'NUTS' AS scheme, station_id % 40 AS code FROM stations)
 SELECT id, coalesce(inline, name) AS geometry, CASE WHEN inline IS NOT NULL THEN 'inline' WHEN name IS NOT NULL THEN 'geocode' END AS provenance FROM a LEFT JOIN areas ON code = area_id""")
def join_geocode(stations, areas):
    own = F.when(F.col("station_id") % 3 == 0, F.concat(F.lit("own "), F.col("station_id").cast("string")))
    wanted = stations.select(F.col("station_id").alias("id"), own.alias("inline"), F.lit("NUTS").alias("scheme"), (F.col("station_id") % 40).alias("code"))
    return features.with_zones(wanted, areas.select(F.lit("NUTS").alias("scheme"), F.col("area_id").alias("code"), F.col("name").alias("geometry")))


# ---------------------------------------------------------------- aggregates


@query("obs areas", "SELECT station_id, coalesce(name, CAST(station_id AS VARCHAR)) AS name, newest FROM (SELECT station_id, max(time) AS newest FROM obs GROUP BY 1) LEFT JOIN areas ON area_id = station_id")
def agg_locations_from_obs(obs, areas):
    return features.reporting_locations(obs, areas.select(F.col("area_id").alias("station_id"), "name"))


@query("obs", "SELECT k AS name, count(*) AS n FROM (SELECT unnest(CASE WHEN value >= 50 THEN ['station', parameter, 'high'] ELSE ['station', parameter] END) AS k FROM obs) GROUP BY 1")
def agg_property_names(obs):
    keys = F.when(F.col("value") >= 50, F.array(F.lit("station"), "parameter", F.lit("high"))).otherwise(F.array(F.lit("station"), "parameter"))
    return obs.select(F.explode(F.map_keys(F.map_from_arrays(keys, keys))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("run_acc", """, g AS (SELECT run_time, step - lag(step) OVER (PARTITION BY run_time ORDER BY step) AS gap FROM (SELECT DISTINCT run_time, step FROM run_acc))
 SELECT run_time, CASE WHEN max(gap) - min(gap) <= 0 THEN CAST(round(avg(gap)) * 3600 AS BIGINT) END AS step_s FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def agg_regular_step(run_acc):
    hours = F.col("run_time").cast("timestamp") + F.make_dt_interval(hours=F.col("step").cast("int"))
    return aggregates.regular_step(run_acc.select("run_time", hours.cast("timestamp_ntz").alias("time")), "run_time")


@query("obs", "SELECT parameter, count(value) AS n, round(sqrt(avg((value - 50) * (value - 50))), 5) AS rmse FROM obs GROUP BY 1")
def agg_loo_rmse(obs):
    residuals = obs.select("parameter", (F.col("value") - 50).alias("residual"))
    out = residuals.groupBy("parameter").agg(F.count("residual").alias("n"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))
    return rounded(out, "rmse")


@query("obs", "SELECT station_id AS id, n AS rank, parameter AS name, value FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY abs(value) DESC, parameter) AS n FROM (SELECT station_id, parameter, max(value) - 50 AS value FROM obs GROUP BY 1, 2)) WHERE n <= 3")
def agg_top_reasons(obs):
    terms = obs.groupBy(F.col("station_id").alias("id"), F.col("parameter").alias("name")).agg((F.max("value") - 50).alias("value"))
    return features.top_reasons(terms)


@query("frames", "SELECT row_idx * 20 + col_idx AS track, frame, value, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY row_idx, col_idx ORDER BY frame DESC) AS n FROM frames) WHERE n <= 6")
def win_cell_history(frames):
    return features.history(frames.select((F.col("row_idx") * 20 + F.col("col_idx")).alias("track"), "frame", "value"), 6)


@query("frames", "SELECT frame, row_idx, col_idx, round((value - 25) * 3.0 * (1 - exp(-frame / 3.0)), 5) + 0.0 AS growth FROM frames")
def win_growth_damped(frames):
    return rounded(frames.select("frame", "row_idx", "col_idx", features.damped_growth(F.col("value") - 25, F.col("frame").cast("double"), 3.0).alias("growth")), "growth").withColumn("growth", F.col("growth") + 0.0)


@query("alerts", "SELECT sender, identifier, sent, severity FROM (SELECT DISTINCT sender, identifier, sent, severity FROM alerts) ORDER BY severity DESC NULLS LAST, sent DESC, sender, identifier LIMIT 100")
def topk_severity(alerts):
    rows = alerts.select("sender", "identifier", "sent", "severity").distinct()
    return rows.orderBy(F.desc_nulls_last("severity"), F.desc("sent"), "sender", "identifier").limit(100)


@query("frames", "SELECT frame, row_idx, col_idx, value FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY value DESC, row_idx, col_idx) AS n FROM frames) WHERE n <= 5")
def topk_cells(frames):
    from pyspark.sql import Window as W

    best = W.partitionBy("frame").orderBy(F.desc("value"), "row_idx", "col_idx")
    return frames.withColumn("n", F.row_number().over(best)).filter("n <= 5").select("frame", "row_idx", "col_idx", "value")


# ---------------------------------------------------------------- sets


@query("obs", "SELECT seq, 'click' AS parameter, value FROM obs WHERE parameter = 'click' UNION ALL SELECT seq, 'view', value FROM obs WHERE parameter = 'view'")
def set_union_parameters(obs):
    one = lambda p: obs.filter(F.col("parameter") == p).select("seq", "value").withColumn("parameter", F.lit(p))
    return one("click").unionByName(one("view")).select("seq", "parameter", "value")


@query("frames", "SELECT frame, row_idx, col_idx, value FROM frames WHERE frame < 30 UNION SELECT frame, row_idx, col_idx, CASE WHEN frame < 25 AND row_idx < 5 THEN value + 1 ELSE value END FROM frames WHERE frame >= 20")
def set_merge_instants(frames):
    revised = frames.filter("frame >= 20").withColumn("value", F.when((F.col("frame") < 25) & (F.col("row_idx") < 5), F.col("value") + 1).otherwise(F.col("value")))
    return sorts.merge_instants([frames.filter("frame < 30"), revised])


@query("notifications", "SELECT data_id, min(id) AS id, count(*) AS n FROM notifications GROUP BY 1")
def set_dedupe_features(notifications):
    return notifications.groupBy("data_id").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("strikes obs", "SELECT min(s.id) AS position, s.station AS station_id, count(*) AS n FROM (SELECT id, id % 200 AS station FROM strikes) s JOIN (SELECT DISTINCT station_id FROM obs) o ON o.station_id = s.station GROUP BY 2")
def set_multipoint(strikes, obs):
    asked = strikes.groupBy((F.col("id") % 200).alias("station_id")).agg(F.min("id").alias("position"), F.count("*").alias("n"))
    return asked.join(obs.select("station_id").distinct(), "station_id", "left_semi").select("position", "station_id", "n")


# ---------------------------------------------------------------- functions


@query("obs", "SELECT seq, round((value - 50) * cos(radians(seq % 90)) + (seq % 41 - 20) * sin(radians(seq % 90)), 5) AS east, round((seq % 41 - 20) * cos(radians(seq % 90)) - (value - 50) * sin(radians(seq % 90)), 5) AS north FROM obs")
def fn_wind_turn(obs):
    east, north = features.turned_wind(F.col("value") - 50, (F.col("seq") % 41 - 20).cast("double"), (F.col("seq") % 90).cast("double"))
    return rounded(obs.select("seq", east.alias("east"), north.alias("north")), "east", "north")


@query("obs", "SELECT seq, round(value * 1000 / 9.80665, 5) AS height FROM obs")
def fn_geopotential_height(obs):
    return rounded(obs.select("seq", (F.col("value") * 1000 / weather.GRAVITY).alias("height")), "height")


_UNITS = ["kg m**-2", "kg/m2", "kg m-2", "m s**-1", "m/s", "m.s-1", "K"]
_CANONICAL = ["kg m-2", "kg m-2", "kg m-2", "m s-1", "m s-1", "m s-1", "K"]


@query("obs", "SELECT unit, count(*) AS n FROM (SELECT (" + str(_CANONICAL) + ")[CAST(seq % 7 AS INT) + 1] AS unit FROM obs) GROUP BY 1")
def fn_canonical_unit(obs):
    spelled = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("seq") % 7 + 1).cast("int"))
    return obs.select(features.canonical_unit(spelled).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


@query("obs", """SELECT seq, CASE seq % 3 WHEN 0 THEN '°C' WHEN 1 THEN 'hPa' ELSE 'm' END AS shown_unit, round(CASE seq % 3 WHEN 0 THEN value - 273.15 WHEN 1 THEN value * 0.01 ELSE value END, 5) AS shown_value FROM obs""")
def fn_display_conversion(obs):
    unit = F.when(F.col("seq") % 3 == 0, "K").when(F.col("seq") % 3 == 1, "Pa").otherwise("m")
    return rounded(features.shown(obs.select("seq", unit.alias("unit"), "value")), "shown_value").select("seq", "shown_unit", "shown_value")


@query("obs", "SELECT seq, seq % 28 * 86400 + seq % 24 * 3600 + seq % 60 AS seconds FROM obs")
def fn_duration(obs):
    text = F.format_string("P%dDT%dH%dS", F.col("seq") % 28, F.col("seq") % 24, F.col("seq") % 60)
    return obs.select("seq", weather.duration_seconds(text).alias("seconds"))


@query("obs", "SELECT seq, CAST(TIMESTAMP '2000-01-01' + to_hours(CAST(seq AS INT)) AS TIMESTAMP) AS time FROM obs")
def fn_cf_time(obs):
    return obs.select("seq", features.cf_time(F.col("seq").cast("double"), F.lit("hours since 2000-01-01")).alias("time"))


@query("strikes", "SELECT CAST(floor((lon - 19) / 0.5) AS INT) AS col_idx, CAST(floor((71 - lat) / 0.5) AS INT) AS row_idx, count(*) AS n FROM strikes GROUP BY 1, 2")
def fn_grid_index(strikes):
    column, row = features.pixel_of(F.col("lon"), F.col("lat"), 19.0, 71.0, 0.5, 0.5)
    return strikes.groupBy(column.alias("col_idx"), row.alias("row_idx")).agg(F.count("*").alias("n"))


@query("gates", "SELECT site, azimuth, range_idx, elangle, CASE WHEN dbz <> 13 THEN dbz * 0.5 - 32 END AS value FROM gates")
def fn_calibrate(gates):
    return gates.filter("dbz is not null").select("site", "azimuth", "range_idx", "elangle", weather.calibrate(F.col("dbz"), 0.5, -32.0, 13.0).alias("value"))


@query("frames", "SELECT CAST(value >= 10 AS INT) + CAST(value >= 20 AS INT) + CAST(value >= 30 AS INT) AS class, count(*) AS n FROM frames GROUP BY 1")
def fn_classify_value(frames):
    return frames.groupBy(weather.classify(F.col("value"), [10, 20, 30]).alias("class")).agg(F.count("*").alias("n"))


@query("frames", "SELECT least(3, CAST(value + 20 >= 45 AS INT) + CAST(value + 20 >= 50 AS INT) + CAST(value + 20 >= 55 AS INT) + CAST(row_idx * 5 >= 50 AS INT)) AS severity, count(*) AS n FROM frames GROUP BY 1")
def fn_severity(frames):
    return frames.groupBy(weather.cell_severity(F.col("value") + 20, F.col("row_idx") * 5).alias("severity")).agg(F.count("*").alias("n"))


@query("alerts", "SELECT severity AS code, count(*) AS n FROM (SELECT coalesce(severity, 0) AS severity FROM alerts) GROUP BY 1")
def fn_severity_code(alerts):
    text = F.element_at(F.array(*map(F.lit, ["Unknown", " minor", "MODERATE", "Severe", "Extreme "])), F.coalesce(F.col("severity"), F.lit(0)) + 1)
    return alerts.groupBy(features.severity_code(text).alias("code")).agg(F.count("*").alias("n"))


@query("obs", """, c AS (SELECT seq, value / 20 AS speed, seq % 12 AS age, CASE WHEN station_id % 7 < 6 THEN station_id % 7 END AS net FROM obs)
 SELECT seq, CASE WHEN net > 3 OR speed IS NULL THEN false ELSE speed < 3 AND age >= 6 END AS clutter FROM c""")
def fn_clutter(obs):
    net = F.when(F.col("station_id") % 7 < 6, F.col("station_id") % 7)
    return obs.select("seq", features.likely_clutter(F.col("value") / 20, F.col("seq") % 12, net).alias("clutter"))


@query("obs", """, r AS (SELECT seq, CASE seq % 5 WHEN 0 THEN value - 50 WHEN 1 THEN value WHEN 2 THEN CAST('infinity' AS DOUBLE) WHEN 3 THEN value * 1000 ELSE value * 20000 END AS raw FROM obs)
 SELECT seq, CASE WHEN raw > 0 AND raw < CAST('infinity' AS DOUBLE) THEN round(greatest(0, least(1, (log10(1 + raw) - log10(101)) / (log10(700001) - log10(101)))), 5) ELSE 0 END AS weight FROM r""")
def fn_weight_log(obs):
    raw = F.when(F.col("seq") % 5 == 0, F.col("value") - 50).when(F.col("seq") % 5 == 1, F.col("value")).when(F.col("seq") % 5 == 2, float("inf")).when(F.col("seq") % 5 == 3, F.col("value") * 1000).otherwise(F.col("value") * 20000)
    return rounded(obs.select("seq", features.log_weight(raw).alias("weight")), "weight")


@query("obs", "SELECT seq, time AS start, CASE WHEN seq % 2 = 0 THEN time + INTERVAL 1 HOUR ELSE time + INTERVAL 6 HOUR END AS \"end\" FROM obs")
def fn_alert_window(obs):
    nothing = F.lit(None).cast("timestamp_ntz")
    expires = F.when(F.col("seq") % 2 == 0, F.col("time") + F.expr("interval 1 hour"))
    start, end = features.alert_window(nothing, nothing, F.col("time"), expires, "6 hours")
    return obs.select("seq", start.alias("start"), end.alias("end"))


@query("alerts", "SELECT DISTINCT 'cap:' || strlen(sender) || ':' || sender || identifier || '.' || severity || '.1' AS id FROM alerts WHERE severity IS NOT NULL")
def fn_ids(alerts):
    return alerts.filter("severity is not null").select(features.feature_id(F.col("sender"), F.col("identifier"), F.col("severity"), F.lit(1)).alias("id")).distinct()


@query("strikes", "SELECT id, round(degrees(2 * atan(exp(ln(tan(pi() / 4 + radians(lat) / 2)))) - pi() / 2), 6) AS lat, round(degrees(asin(sin(radians(lat)) * cos(0.01) + cos(radians(lat)) * sin(0.01) * cos(radians(60)))), 6) AS reached FROM strikes")
def fn_destination(strikes):
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    _, reached = geo.destination(F.col("lon"), F.col("lat"), F.lit(60.0), F.lit(63_710.0))
    return rounded(strikes.select("id", geo.unmercator(x, y)[1].alias("lat"), reached.alias("reached")), "lat", "reached", digits=6)


@query("obs", "SELECT seq, CASE WHEN value IS NOT NULL THEN round((value / 1e4) * 100000 / (0.62198 + (1 - 0.62198) * (value / 1e4)), 4) END AS pressure FROM obs")
def fn_vapour_pressure(obs):
    return rounded(obs.select("seq", weather.vapour_pressure(F.col("value") / 1e4, F.lit(100_000.0)).alias("pressure")), "pressure", digits=4)
