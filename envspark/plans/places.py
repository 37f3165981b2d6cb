"""Registered queries over grids of irregular nodes and map tiles, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.operators import curvilinear, revision, tiles
from envspark.plans.registry import _HAVERSINE, _IDW, grid_places, query, rounded

#: The frames' rows and columns as nodes of a bent grid over the box of the stations.
_NODE = "20 + 0.45e0 * col_idx + 0.12e0 * row_idx + 0.006e0 * row_idx * col_idx AS lon, 60.5e0 + 0.4e0 * row_idx - 0.07e0 * col_idx AS lat"
_PLACED = """SELECT *, coalesce(CASE WHEN s1 IS NULL THEN false WHEN s2 IS NULL OR t2 IS NULL THEN true ELSE greatest(abs(s1 - 0.5), abs(t1 - 0.5)) <= greatest(abs(s2 - 0.5), abs(t2 - 0.5)) END, false) AS one FROM (
 SELECT *, -((fe + s1 * e1e) * (e2e + s1 * e3e) + (fn + s1 * e1n) * (e2n + s1 * e3n)) / nullif((e2e + s1 * e3e) ** 2 + (e2n + s1 * e3n) ** 2, 0) AS t1, -((fe + s2 * e1e) * (e2e + s2 * e3e) + (fn + s2 * e1n) * (e2n + s2 * e3n)) / nullif((e2e + s2 * e3e) ** 2 + (e2n + s2 * e3n) ** 2, 0) AS t2 FROM (
 SELECT *, k0 / nullif(h, 0) AS s1, h / nullif(k2, 0) AS s2 FROM (SELECT *, -(k1 + CASE WHEN k1 < 0 THEN -1 ELSE 1 END * sqrt(greatest(k1 * k1 - 4 * k2 * k0, 0))) / 2 AS h FROM (
 SELECT *, e1e * e3n - e1n * e3e AS k2, fe * e3n - fn * e3e + e1e * e2n - e1n * e2e AS k1, fe * e2n - fn * e2e AS k0 FROM (SELECT id, col, row, fe, fn, ge - fe AS e1e, gn - fn AS e1n, he - fe AS e2e, hn - fn AS e2n, fe - ge - he + ke AS e3e, fn - gn - hn + kn AS e3n FROM (
 SELECT id, col, row, {flat} FROM {source}))))))"""
_FLAT = ", ".join(f"({k}x * ex + {k}y * ey) / ({k}x * px + {k}y * py + {k}z * pz) AS {k}e, ({k}x * nx + {k}y * ny + {k}z * nz) / ({k}x * px + {k}y * py + {k}z * pz) AS {k}n" for k in "fghk")
_LOCATE = f""", raw AS (SELECT DISTINCT col_idx AS col, row_idx AS row, {_NODE} FROM frames), node AS (SELECT col, row, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM raw),
 cell AS (SELECT f.col, f.row, {', '.join(f'{k}.{c} AS {k}{c}' for k in 'fghk' for c in 'xyz')} FROM node f JOIN node g ON g.col = f.col + 1 AND g.row = f.row JOIN node h ON h.col = f.col AND h.row = f.row + 1 JOIN node k ON k.col = f.col + 1 AND k.row = f.row + 1),
 p AS (SELECT id, cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py, sin(radians(lat)) AS pz, -sin(radians(lon)) AS ex, cos(radians(lon)) AS ey, -sin(radians(lat)) * cos(radians(lon)) AS nx, -sin(radians(lat)) * sin(radians(lon)) AS ny, cos(radians(lat)) AS nz FROM strikes),
 met AS (SELECT * FROM p, cell WHERE (px - fx) ** 2 + (py - fy) ** 2 + (pz - fz) ** 2 < 0.0009), hit AS ({_PLACED.format(flat=_FLAT, source='met')}), best AS (SELECT id, col, row, CASE WHEN one THEN s1 ELSE s2 END AS s, CASE WHEN one THEN t1 ELSE t2 END AS t FROM hit),
 inner_ AS (SELECT id, arg_min(col + s, (row, col)) AS col, arg_min(row + t, (row, col)) AS row FROM best WHERE greatest(abs(s - 0.5), abs(t - 0.5)) <= 0.5 + 1e-9 GROUP BY id),
 gap AS (SELECT n.col, n.row, n.x, n.y, n.z, 3 * max(sqrt((n.x - m.x) ** 2 + (n.y - m.y) ** 2 + (n.z - m.z) ** 2)) AS reach FROM node n JOIN node m ON abs(n.col - m.col) + abs(n.row - m.row) = 1 WHERE (SELECT count(*) FROM cell k WHERE n.col - k.col IN (0, 1) AND n.row - k.row IN (0, 1)) < 4 GROUP BY ALL),
 far AS (SELECT id, arg_min(struct_pack(col, row, reach), (sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2), row, col)) AS n, min(sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2)) AS d FROM p ANTI JOIN inner_ USING (id), gap WHERE sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) < 0.08 GROUP BY id),
 past AS (SELECT b.* FROM best b JOIN far USING (id) WHERE far.d <= far.n.reach AND far.n.col - b.col IN (0, 1) AND far.n.row - b.row IN (0, 1)
  AND (s >= -1e-9 OR (b.col = 0 AND s >= -2)) AND (s <= 1 + 1e-9 OR (b.col = 18 AND s <= 3)) AND (t >= -1e-9 OR (b.row = 0 AND t >= -2)) AND (t <= 1 + 1e-9 OR (b.row = 18 AND t <= 3))),
 outer_ AS (SELECT id, arg_min(col + s, (row, col)) AS col, arg_min(row + t, (row, col)) AS row FROM past GROUP BY id)
 SELECT id, round(u.col, 5) AS col, round(u.row, 5) AS row FROM strikes LEFT JOIN (SELECT * FROM inner_ UNION ALL SELECT * FROM outer_) u USING (id)"""


@query("strikes frames", _LOCATE)
def grid_curvilinear_locate(strikes, frames):
    grid = frames.select("col_idx", "row_idx").distinct().selectExpr("col_idx AS col", "row_idx AS row", *[c.strip() for c in _NODE.split(",")])
    return rounded(curvilinear.locate(strikes.select("id", "lon", "lat"), grid, 20, 20), "col", "row")


#: Squares around strikes with a hole of half their width, on the tiles of zoom 8.
_UNROLLED = "({lon} / 360 + 0.5) * 256 AS {x}, (0.5 - ln(tan(pi() / 4 + radians({lat}) / 2)) / (2 * pi())) * 256 AS {y}"
_SQUARES = f""", sq AS (SELECT id, lon, lat, 0.05e0 + (id % 50) / 40e0 AS w FROM strikes),
 b AS (SELECT id, {_UNROLLED.format(lon='(lon - w)', lat='(lat + w / 2)', x='x0', y='y0')}, {_UNROLLED.format(lon='(lon + w)', lat='(lat - w / 2)', x='x1', y='y1')}, {_UNROLLED.format(lon='(lon - w / 2)', lat='(lat + w / 4)', x='hx0', y='hy0')}, {_UNROLLED.format(lon='(lon + w / 2)', lat='(lat - w / 4)', x='hx1', y='hy1')} FROM sq),
 tx AS (SELECT *, unnest(range(CAST(ceil(x0 - 1.0625) AS INT), CAST(floor(x1 + 0.0625) AS INT) + 1)) AS tile_x FROM b), txy AS (SELECT *, unnest(range(CAST(ceil(y0 - 1.0625) AS INT), CAST(floor(y1 + 0.0625) AS INT) + 1)) AS tile_y FROM tx)"""
_SHARED = "greatest(0, least({p}x1, tile_x + 1.0625e0) - greatest({p}x0, tile_x - 0.0625e0)) * greatest(0, least({p}y1, tile_y + 1.0625e0) - greatest({p}y0, tile_y - 0.0625e0)) * 4096 * 4096"


@query("strikes", f"{_SQUARES} SELECT id, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y, round({_SHARED.format(p='')}, 1) AS outer_area, round({_SHARED.format(p='h')}, 1) AS hole_area FROM txy")
def tile_features(strikes):
    w = 0.05 + (F.col("id") % 50) / 40.0
    corner = lambda x, y, share: F.struct((F.col("lon") + share * x * w).alias("x"), (F.col("lat") + share * y * w / 2).alias("y"))
    ring = lambda share: F.array(*[corner(x, y, share) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    cut = tiles.tile_polygons(strikes.select("id", F.array(ring(1.0), ring(0.5)).alias("rings")), ["id"], 8)
    holes = F.aggregate(F.slice("rings", 2, F.size("rings")), F.lit(0.0), lambda s, r: s - tiles.ring_area(r))
    return rounded(cut.select("id", "tile_x", "tile_y", tiles.ring_area(F.col("rings")[0]).alias("outer_area"), holes.alias("hole_area")), "outer_area", "hole_area", digits=1)


@query("strikes", f""", u AS (SELECT id, {_UNROLLED.format(lon='lon', lat='lat', x='u', y='v')} FROM strikes), n AS (SELECT unnest(range(256)) AS t)
 SELECT id, CAST(a.t AS INTEGER) AS tile_x, CAST(b.t AS INTEGER) AS tile_y, round((u - a.t) * 4096, 4) AS x, round((v - b.t) * 4096, 4) AS y FROM u JOIN n a ON u BETWEEN a.t - 0.0625 AND a.t + 1.0625 JOIN n b ON v BETWEEN b.t - 0.0625 AND b.t + 1.0625""")
def tile_feature_points(strikes):
    return rounded(tiles.tile_points(strikes, ["id"], 8), "x", "y", digits=4)


_HOURLY = "SELECT date_trunc('hour', time) AS time, station_id, avg(value) AS value FROM obs WHERE value IS NOT NULL{late} GROUP BY 1, 2"


@query("stations obs", f""", t AS (SELECT x * 20 + y AS id, 19.3 + x * 0.65 AS lon, 59.3 + y * 0.6 AS lat FROM (SELECT range AS x FROM range(20)), (SELECT range AS y FROM range(20))), v AS ({_HOURLY.format(late='')}),
 late AS (SELECT DISTINCT date_trunc('hour', time) AS time FROM obs WHERE seq % 400 = 0 AND value IS NOT NULL), near AS (SELECT struct_pack(t := v.time, i := t.id) AS id, s.station_id, v.value, {_HAVERSINE.format(a='t', b='s')} AS d FROM t JOIN stations s ON abs(s.lat - t.lat) < 2 JOIN v ON v.station_id = s.station_id JOIN late ON late.time = v.time), {_IDW.format(extra='', metres=120000)}
 SELECT id.t AS time, id.i AS id, round(sum(w * value) / sum(w), 4) AS estimate, count(*) AS neighbours FROM w GROUP BY 1, 2""")
def interp_revision(stations, obs):
    """Fields of the hours whose reports aren't those of a run before the late ones (every 400th) came."""
    cells = obs.sparkSession.range(400).select("id", *grid_places(F.floor(F.col("id") / 20), F.col("id") % 20, 1930, 5930))
    hour = F.date_trunc("hour", "time").cast("timestamp_ntz")
    hourly = lambda rows: rows.filter("value is not null").groupBy(hour.alias("time"), "station_id").agg(F.avg("value").alias("value"))
    values = hourly(obs)
    # the reports, not their means, which a late one may leave as they were
    reports = lambda rows: revision.inputs(stations, rows.select(hour.alias("time"), "station_id", "value"))
    times = revision.changed_times(reports(obs), reports(obs.filter("seq % 400 <> 0")))
    return rounded(revision.at_times(cells, stations, values.join(times, "time", "left_semi"), 120_000).select("time", "id", "estimate", "neighbours"), "estimate", digits=4)


@query("obs", """, s AS (SELECT floor(epoch_ms(min(time)) / 1000.0) AS a, floor(epoch_ms(max(time)) / 1000.0) AS b FROM obs)
 SELECT make_timestamp(n * 600 * 1000000) AS time FROM (SELECT unnest(range(CAST(greatest(ceil(a / 600), floor(b / 600) - 3999) AS BIGINT), CAST(floor(b / 600) AS BIGINT) + 1)) AS n FROM s)""")
def interp_times(obs):
    """The latest 4,000 whole ten minutes of the reports."""
    return revision.analysis_times(obs, 600, 4000)
