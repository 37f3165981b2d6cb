"""Registered queries over contours, paths, polygons and the motion field, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.operators import areas as regions
from envspark.operators import features, impact, joins, nowcast, paths
from envspark.plans.registry import query, rounded

_SQUARES = """, q AS (SELECT a.frame, a.row_idx, a.col_idx, a.value AS tl, b.value AS tr, c.value AS bl, d.value AS br FROM frames a
  JOIN frames b ON b.frame = a.frame AND b.row_idx = a.row_idx AND b.col_idx = a.col_idx + 1 JOIN frames c ON c.frame = a.frame AND c.row_idx = a.row_idx + 1 AND c.col_idx = a.col_idx
  JOIN frames d ON d.frame = a.frame AND d.row_idx = a.row_idx + 1 AND d.col_idx = a.col_idx + 1),
 k AS (SELECT *, CAST(ceil((least(tl, tr, bl, br) - 2.5) / 5) AS BIGINT) AS k0, CAST(floor((greatest(tl, tr, bl, br) - 2.5) / 5) AS BIGINT) AS k1 FROM q WHERE least(tl, tr, bl, br) < greatest(tl, tr, bl, br)),
 lv AS (SELECT *, 2.5 + 5.0 * unnest(range(k0, least(k1, k0 + 3) + 1)) AS level FROM k),
 e AS (SELECT *, (tl >= level)::INT + 2 * (tr >= level)::INT + 4 * (br >= level)::INT + 8 * (bl >= level)::INT AS c, [col_idx + (level - tl) / (tr - tl), row_idx] AS t, [col_idx + (level - bl) / (br - bl), row_idx + 1] AS b,
  [col_idx, row_idx + (level - tl) / (bl - tl)] AS l, [col_idx + 1, row_idx + (level - tr) / (br - tr)] AS r FROM lv),
 s AS (SELECT *, CASE WHEN c IN (1, 14) THEN [[l, t]] WHEN c IN (2, 13) THEN [[t, r]] WHEN c IN (3, 12) THEN [[l, r]] WHEN c IN (4, 11) THEN [[r, b]] WHEN c IN (6, 9) THEN [[t, b]] WHEN c IN (7, 8) THEN [[l, b]]
  WHEN ((tl + tr + br + bl) / 4 >= level) = (c = 5) THEN [[t, r], [l, b]] ELSE [[l, t], [r, b]] END AS lines FROM e WHERE c NOT IN (0, 15)),
 p AS (SELECT frame, row_idx, col_idx, level, unnest(range(len(lines))) AS part, unnest(lines) AS g FROM s)"""


@query("frames", f"{_SQUARES} SELECT frame, row_idx, col_idx, level, CAST(part AS INTEGER) AS part, round(g[1][1], 5) AS x1, round(g[1][2], 5) AS y1, round(g[2][1], 5) AS x2, round(g[2][2], 5) AS y2 FROM p")
def grid_contours(frames):
    return rounded(paths.contours(frames, ["frame"], 2.5, 5.0), "x1", "y1", "x2", "y2")


#: A path of four strikes, one vertex every two hours; a frame every five minutes over the box of the stations.
WEST, NORTH, D_LON, D_LAT = 19.0, 71.0, 0.65, 0.6
_STEPS = """, v AS (SELECT id // 4 AS path, id AS place, lon, lat, TIMESTAMP '2024-01-01' + to_minutes((id % 4) * 120) AS t FROM strikes),
 g AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, row_number() OVER w AS h FROM v WINDOW w AS (PARTITION BY path ORDER BY place)),
 d AS (SELECT *, acos(greatest(-1, least(1, cos(radians(lat)) * cos(radians(lat2)) * cos(radians(lon)) * cos(radians(lon2)) + cos(radians(lat)) * sin(radians(lon)) * cos(radians(lat2)) * sin(radians(lon2)) + sin(radians(lat)) * sin(radians(lat2))))) AS d,
  CAST(greatest(1, ceil(greatest(abs(lon2 - lon) / 0.65, abs(lat2 - lat) / 0.6))) AS BIGINT) AS n FROM g),
 e AS (SELECT *, unnest(range(1, n + 1)) AS k FROM d WHERE lon2 IS NOT NULL),
 w AS (SELECT *, CAST(k AS DOUBLE) / n AS f, sin((1 - CAST(k AS DOUBLE) / n) * d) / sin(d) AS wa, sin(CAST(k AS DOUBLE) / n * d) / sin(d) AS wb FROM e),
 x AS (SELECT path, place, k, n, f, t, lon2, lat2, wa * cos(radians(lat)) * cos(radians(lon)) + wb * cos(radians(lat2)) * cos(radians(lon2)) AS px, wa * cos(radians(lat)) * sin(radians(lon)) + wb * cos(radians(lat2)) * sin(radians(lon2)) AS py, wa * sin(radians(lat)) + wb * sin(radians(lat2)) AS pz FROM w),
 samples AS (SELECT path, place, 0 AS k, lon, lat, 0.0 AS minutes, t FROM g WHERE h = 1 UNION ALL
  SELECT path, place, k, CASE WHEN k = n THEN lon2 ELSE degrees(atan2(py, px)) END, CASE WHEN k = n THEN lat2 ELSE degrees(atan2(pz, sqrt(px * px + py * py))) END, f * 120, t + to_milliseconds(CAST(round(f * 7200000) AS BIGINT)) FROM x),
 numbered AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY place, k) - 1 AS n, lon, lat, t FROM samples)"""


def _path_samples(strikes):
    t = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=((F.col("id") % 4) * 120).cast("int"))
    vertices = strikes.select(F.floor(F.col("id") / 4).alias("path"), F.col("id").alias("place"), "lon", "lat", F.lit(None).cast("double").alias("z"), t.alias("t"))
    return paths.densify(vertices, D_LON, D_LAT)


@query("strikes", f"{_STEPS} SELECT path, n, round(lon, 6) AS lon, round(lat, 6) AS lat, t FROM numbered")
def grid_trajectory_samples(strikes):
    return rounded(_path_samples(strikes).select("path", "n", "lon", "lat", "t"), "lon", "lat", digits=6)


@query("strikes frames", f"""{_STEPS}, whole AS (SELECT path, n, t, round(lon, 9) AS lon, round(lat, 9) AS lat FROM numbered), near AS (SELECT *, CAST(least(83, greatest(0, ceil(epoch_ms(t) / 300000.0 - epoch_ms(TIMESTAMP '2024-01-01') / 300000.0 - 0.5))) AS INTEGER) AS frame, (lon - 19) / 0.65 - 0.5 AS gx, (71 - lat) / 0.6 - 0.5 AS gy FROM whole),
 c AS (SELECT path, n, a.frame, o.k, w.value, (CASE WHEN o.dc = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN o.dr = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) AS share
  FROM near a, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) AS o(k, dr, dc) JOIN frames w ON w.frame = a.frame AND w.row_idx = floor(gy) + o.dr AND w.col_idx = floor(gx) + o.dc)
 SELECT path, n, frame, round(CASE WHEN count(*) = 4 THEN sum(value * share) ELSE arg_max(value, (share, -k)) END, 4) AS value FROM c GROUP BY 1, 2, 3""")
def grid_trajectory(strikes, frames):
    """The frame at or next to each sample's time, along the path."""
    times = [f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00" for m in range(0, 84 * 5, 5)]
    at = paths.nodes(rounded(_path_samples(strikes), "lon", "lat", digits=9), times, [], True, False)  # engines' sines differ in the last bits
    frame = (F.unix_seconds(F.col("time").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 300
    points = at.withColumn("frame", frame.cast("int")).drop("level", "time")
    return rounded(paths.sampled(points, frames, ["frame"], WEST, NORTH, D_LON, D_LAT).filter("value is not null").select("path", "n", "frame", "value"), "value", digits=4)


@query("frames")
def nc_motion_filter(frames):
    vectors = rounded(nowcast.motion(frames, 5, 2, 20.0), "d_row", "d_col", digits=4)
    return rounded(nowcast.filter_motion(vectors, 4, 4), "d_row", "d_col")


def _shapes(areas):
    """Squares with a square hole, squares without their north-eastern quarter, and triangles."""
    part = lambda a, b, f: F.col(a) + (F.col(b) - F.col(a)) * f
    x = {"w": F.col("west"), "e": F.col("east"), "l": part("west", "east", 0.25), "m": part("west", "east", 0.5), "r": part("west", "east", 0.75)}
    y = {"s": F.col("south"), "n": F.col("north"), "l": part("south", "north", 0.25), "m": part("south", "north", 0.5), "r": part("south", "north", 0.75)}
    ring = lambda text: F.array(*[F.struct(x[a].alias("x"), y[b].alias("y")) for a, b in text.split()])
    holed = F.array(ring("ws es en wn ws"), ring("ll rl rr lr ll"))
    shapes = F.when(F.col("area_id") % 3 == 0, holed).when(F.col("area_id") % 3 == 1, F.array(ring("ws es em mm mn wn ws"))).otherwise(F.array(ring("ws es wn ws")))
    return areas.select("area_id", shapes.alias("rings"))


@query("strikes areas", """, a AS (SELECT *, west + (east - west) * 0.25e0 AS hw, west + (east - west) * 0.75e0 AS he, south + (north - south) * 0.25e0 AS hs, south + (north - south) * 0.75e0 AS hn, west + (east - west) * 0.5e0 AS mx, south + (north - south) * 0.5e0 AS my FROM areas)
 SELECT id, area_id FROM strikes JOIN a ON lon BETWEEN west AND east AND lat BETWEEN south AND north AND CASE area_id % 3
  WHEN 0 THEN NOT (lon BETWEEN hw AND he AND lat BETWEEN hs AND hn) WHEN 1 THEN NOT (lon > mx AND lat > my) ELSE (lon - west) / (east - west) + (lat - south) / (north - south) <= 1 END""")
def flt_polygon(strikes, areas):
    """Strikes in squares with a square hole, in squares without their north-eastern quarter, and in triangles."""
    return joins.points_in_areas(strikes, _shapes(areas))


@query("strikes areas", """, c AS (SELECT id, lon, lat, CASE WHEN id % 7 > 0 THEN (id % 40) * 1.0e0 END AS speed, (id * 37 % 360) * 1.0e0 AS bearing FROM strikes),
 a AS (SELECT *, greatest(0, least(1, (log10(1 + (area_id + 1) * 5000) - log10(101)) / (log10(700001) - log10(101)))) AS weight FROM areas WHERE area_id % 2 = 0),
 s AS (SELECT *, unnest(CASE WHEN speed > 0 THEN range(0, 31) ELSE [0] END) AS k FROM c), d AS (SELECT *, coalesce(speed, 0) * k * 120 / 6371000.0 AS d FROM s),
 q AS (SELECT *, asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(bearing))) AS phi FROM d),
 at AS (SELECT id, k, CASE WHEN k = 0 THEN lon ELSE degrees(radians(lon) + atan2(sin(radians(bearing)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(phi))) END AS lon, CASE WHEN k = 0 THEN lat ELSE degrees(phi) END AS lat FROM q),
 met AS (SELECT id, k, min(area_id) AS area_id FROM "at" JOIN a ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY 1, 2),
 o AS (SELECT id, area_id AS over FROM met WHERE k = 0), f AS (SELECT m.id, arg_min(area_id, k) AS approaching, min(k) * 2.0e0 AS eta_minutes FROM met m LEFT JOIN o USING (id) WHERE k > 0 AND (over IS NULL OR over <> area_id) GROUP BY 1)
 SELECT c.id, coalesce(over, -1) AS over, coalesce(approaching, -1) AS approaching, eta_minutes, round(CASE WHEN over IS NOT NULL THEN x.weight WHEN approaching IS NOT NULL THEN y.weight * (1 - eta_minutes / 60) * 0.7 ELSE 0 END, 5) AS exposure
 FROM c LEFT JOIN o USING (id) LEFT JOIN f USING (id) LEFT JOIN a x ON x.area_id = o.over LEFT JOIN a y ON y.area_id = f.approaching""".replace(" at AS (", ' "at" AS ('))
def join_impact_eta(strikes, areas):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))
    shapes = areas.filter("area_id % 2 = 0").select("area_id", features.log_weight((F.col("area_id") + 1) * 5000.0).alias("weight"), F.array(ring).alias("rings"))
    cells = strikes.select("id", "lon", "lat", F.when(F.col("id") % 7 > 0, (F.col("id") % 40).cast("double")).alias("speed_ms"), (F.col("id") * 37 % 360).cast("double").alias("bearing_deg"))
    return rounded(impact.impact(cells, shapes).fillna(-1, ["over", "approaching"]), "exposure")


#: Areas on a grid of 0.4 degrees, of 30 cells at most: five by six of the seven by six that they would have.
_AREA = """, a AS (SELECT *, west + (east - west) * 0.25e0 AS hw, west + (east - west) * 0.75e0 AS he, south + (north - south) * 0.25e0 AS hs, south + (north - south) * 0.75e0 AS hn, west + (east - west) * 0.5e0 AS mx, south + (north - south) * 0.5e0 AS my FROM areas),
 g AS (SELECT area_id, ix, iy, west + (ix + 0.5e0) * ((east - west) / 5) AS lon, north - (iy + 0.5e0) * ((north - south) / 6) AS lat FROM a, (SELECT range AS ix FROM range(5)), (SELECT range AS iy FROM range(6))),
 h AS (SELECT g.*, round(lon, 9) AS rx, round(lat, 9) AS ry, CASE area_id % 3 WHEN 0 THEN NOT (lon BETWEEN hw AND he AND lat BETWEEN hs AND hn) WHEN 1 THEN NOT (lon > mx AND lat > my) ELSE (lon - west) / (east - west) + (lat - south) / (north - south) <= 1 END AS inside FROM g JOIN a USING (area_id)),
 p AS (SELECT *, (rx - 19) / 0.65 - 0.5 AS gx, (71 - ry) / 0.6 - 0.5 AS gy FROM h WHERE inside),
 c AS (SELECT area_id, ix, iy, w.frame, o.k, w.value, (CASE WHEN o.dc = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN o.dr = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) AS share
  FROM p, (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) AS o(k, dr, dc) JOIN frames w ON w.row_idx = floor(gy) + o.dr AND w.col_idx = floor(gx) + o.dc),
 v AS (SELECT area_id, ix, iy, frame, CASE WHEN count(*) = 4 THEN sum(value * share) ELSE arg_max(value, (share, -k)) END AS value FROM c GROUP BY 1, 2, 3, 4)"""


@query("frames areas", f"{_AREA} SELECT area_id, frame, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, round(lon, 5) AS lon, round(lat, 5) AS lat, inside, true AS coarsened, round(value, 4) AS value FROM h CROSS JOIN (SELECT DISTINCT frame FROM frames) LEFT JOIN v USING (area_id, ix, iy, frame)")
def grid_area(frames, areas):
    cells = rounded(regions.area_cells(_shapes(areas), 0.4, 0.4, 30), "lon", "lat", digits=9)
    found = regions.area_values(cells, frames, ["frame"], WEST, NORTH, D_LON, D_LAT)
    return rounded(rounded(found.select("area_id", "frame", "ix", "iy", "lon", "lat", "inside", "coarsened", "value"), "lon", "lat"), "value", digits=4)
