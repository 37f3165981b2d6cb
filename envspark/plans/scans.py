"""Registered queries over radar volumes: cells in three dimensions and their tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.functions import geo
from envspark.operators import cells3d
from envspark.plans.registry import query, rounded

#: Rings of 4 km, sectors of 10 degrees, layers of 500 m; a scan every 300 s.
GRID = cells3d.Grid(25, 36, 4000.0, 500.0)
SECONDS = 300.0

_DA = "radians(10.0e0)"
_CORNERS = "[{r}0 * {f}({a}), {r}1 * {f}({a}), {r}0 * {f}({a} + {d}), {r}1 * {f}({a} + {d})]"
_EAST, _NORTH = (_CORNERS.format(r="r", a="a0", d=_DA, f=f) for f in ("sin", "cos"))
_DESTINATION = """asin(sin(radians(lat0)) * cos({d} / 6371000.0) + cos(radians(lat0)) * sin({d} / 6371000.0) * cos({b}))"""
_LON = """degrees(radians(lon0) + atan2(sin({b}) * sin({d} / 6371000.0) * cos(radians(lat0)), cos({d} / 6371000.0) - sin(radians(lat0)) * sin({p})))"""
_CELLS = f""", b AS (SELECT *, (range_idx + 1) * 1000.0e0 AS s, 6371000.0e0 * 4 / 3 AS q FROM scans), h AS (SELECT *, sqrt(s * s + q * q + 2 * q * s * sin(radians(elangle))) - q AS up FROM b),
 v AS (SELECT site, scan, CAST(floor(q * asin(s * cos(radians(elangle)) / (q + up)) / 4000) AS BIGINT) AS i_r, CAST(azimuth // 10 AS BIGINT) AS i_a, CAST(floor(up / 500) AS BIGINT) AS i_h, max(dbz) AS dbz FROM h GROUP BY ALL),
 m AS (SELECT * FROM v WHERE dbz >= 35 AND i_r BETWEEN 0 AND 24), wet AS (SELECT DISTINCT site, scan, i_r, i_a FROM m), o AS (SELECT x, y FROM (SELECT unnest([-1, 0, 1]) AS x), (SELECT unnest([-1, 0, 1]) AS y)),
 grown AS (SELECT DISTINCT site, scan, i_r + x AS i_r, (i_a + y + 36) % 36 AS i_a FROM wet, o WHERE i_r + x BETWEEN 0 AND 24),
 shut AS (SELECT g.site, g.scan, g.i_r, g.i_a FROM grown g CROSS JOIN o LEFT JOIN grown n ON n.site = g.site AND n.scan = g.scan AND n.i_r = g.i_r + x AND n.i_a = (g.i_a + y + 36) % 36 GROUP BY ALL HAVING count(*) FILTER (n.i_r IS NULL AND g.i_r + x BETWEEN 0 AND 24) = 0),
 reach AS (SELECT site, scan, i_r, i_a, i_r * 36 + i_a AS part FROM shut
  UNION SELECT w.site, w.scan, w.i_r, w.i_a, r.part FROM reach r JOIN shut w ON w.site = r.site AND w.scan = r.scan AND ((w.i_r = r.i_r AND (w.i_a - r.i_a + 36) % 36 IN (1, 35)) OR (w.i_a = r.i_a AND abs(w.i_r - r.i_r) = 1)) WHERE w.i_r * 36 + w.i_a > r.part),
 parts AS (SELECT site, scan, i_r, i_a, min(part) AS part FROM reach GROUP BY ALL),
 foot AS (SELECT site, scan, part, sum(4000 * ((i_r + 0.5e0) * 4000) * {_DA}) / 1e6 AS area FROM parts GROUP BY ALL),
 x AS (SELECT m.*, part, pow(10, dbz / 10) AS w, (i_r + 0.5e0) * 4000 AS r, i_r * 4000e0 AS r0, (i_r + 1) * 4000e0 AS r1, i_a * {_DA} AS a0, (i_a + 0.5e0) * {_DA} AS a FROM m JOIN parts USING (site, scan, i_r, i_a)),
 liquid AS (SELECT site, scan, part, max(vil) AS vil FROM (SELECT site, scan, part, i_r, i_a, sum(3.44e-6 * pow(pow(10, least(dbz, 56) / 10), 4e0 / 7) * 500) AS vil FROM x GROUP BY ALL) GROUP BY ALL),
 total AS (SELECT site, scan, part, sum(4000 * {_DA} * r * 500) / 1e9 AS volume, sum(w) AS w, sum(w * r * sin(a)) / sum(w) AS e, sum(w * r * cos(a)) / sum(w) AS n, sum(w * (i_h + 0.5e0) * 500) / sum(w) AS u, max(dbz) AS max_dbz, arg_min(struct_pack(r := r, a := a, h := i_h), (-dbz, i_r, i_a, i_h)) AS t,
  min(i_h) AS low, max(i_h) + 1 AS high, min(list_min({_EAST})) AS west, max(list_max({_EAST})) AS east, min(list_min({_NORTH})) AS south, max(list_max({_NORTH})) AS north FROM x GROUP BY ALL HAVING volume >= 5),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY site, scan ORDER BY round(volume, 6) DESC, part) AS label, 22.0e0 + 3 * site AS lon0, 61.0e0 + 3 * site AS lat0, 100e0 * site AS up0, sqrt(e * e + n * n) AS d, atan2(e, n) AS b FROM total),
 placed AS (SELECT *, {_DESTINATION.format(d='d', b='b')} AS p, {_DESTINATION.format(d='t.r', b='t.a')} AS tp FROM ranked WHERE label <= 256)
 SELECT site, scan, label, max_dbz, round({_LON.format(d='t.r', b='t.a', p='tp')}, 5) AS max_lon, round(degrees(tp), 5) AS max_lat, up0 + (t.h + 0.5e0) * 500 AS max_height, round({_LON.format(d='d', b='b', p='p')}, 5) AS lon, round(degrees(p), 5) AS lat, round(up0 + u, 3) AS height,
  up0 + high * 500 AS echo_top, up0 + low * 500 AS base, round(volume, 4) AS volume_km3, round(area, 4) AS area_km2, round(vil, 5) AS vil, round(west, 2) + 0e0 AS west, round(south, 2) + 0e0 AS south, round(east, 2) + 0e0 AS east, round(north, 2) + 0e0 AS north, low * 500e0 AS bottom, high * 500e0 AS top
 FROM placed JOIN foot USING (site, scan, part) JOIN liquid USING (site, scan, part)"""


def _cells(scans):
    slant = (F.col("range_idx") + 1) * 1000.0
    at = scans.withColumns({"i_r": F.floor(geo.slant_to_ground(slant, F.col("elangle")) / GRID.dr), "i_a": F.floor(F.col("azimuth") / 10), "i_h": F.floor(geo.beam_height(slant, F.col("elangle")) / GRID.dh)})
    voxels = at.groupBy("site", "scan", "i_r", "i_a", "i_h").agg(F.max("dbz").alias("dbz"))
    site = F.col("site")
    sites = scans.select("site").distinct().select("site", (22.0 + 3 * site).alias("lon"), (61.0 + 3 * site).alias("lat"), (100.0 * site).alias("height"))
    return cells3d.storm_cells(voxels, ["site", "scan"], GRID, sites, ["site"])


@query("scans", _CELLS, recursive=True)
def vol_cells(scans):
    cells = rounded(rounded(_cells(scans), "max_lon", "max_lat", "lon", "lat", "vil"), "volume_km3", "area_km2", digits=4)
    return rounded(rounded(cells, "height", digits=3), "west", "south", "east", "north", digits=2)


@query("scans")
def vol_tracks(scans):
    """Cells of each radar's scans with their tracks; scans are months here, taken as 300 s apart."""
    return rounded(cells3d.greedy_tracks(_cells(scans).withColumn("at", F.col("scan") * SECONDS), "site"), "u", "v", digits=4)
