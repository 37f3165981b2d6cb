"""Registered queries over cells: segments, matching, tracks and lightning, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.operators import features, nowcast, tracking
from envspark.plans.registry import query, rounded

#: The frames' grid here: cells of 2 km, a frame every 300 s, echoes from 30 on.
WIDTH, PIXEL_KM, SECONDS, ECHO = 20, 2.0, 300.0, 30.0
GATE = tracking.BASE_GATE_KM + tracking.MAX_SPEED_MS * SECONDS / 1000

_SEGMENT = f""", wet AS (SELECT frame, row_idx, col_idx, value, row_idx * {WIDTH} + col_idx AS pixel FROM frames WHERE value >= {ECHO}),
 reach AS (SELECT frame, row_idx, col_idx, pixel AS label FROM wet
  UNION SELECT w.frame, w.row_idx, w.col_idx, r.label FROM reach r JOIN wet w ON w.frame = r.frame AND abs(w.row_idx - r.row_idx) <= 1 AND abs(w.col_idx - r.col_idx) <= 1 WHERE w.pixel > r.label),
 seg AS (SELECT w.frame, w.row_idx, w.col_idx, w.value, min(r.label) AS label FROM wet w JOIN reach r USING (frame, row_idx, col_idx) GROUP BY ALL)"""
_CELLS = f"""{_SEGMENT}, raw AS (SELECT frame, label, count(*) AS pixels, max(value) AS most, sum(value - {ECHO}) AS volume, sum((value - {ECHO}) * row_idx) AS r, sum((value - {ECHO}) * col_idx) AS c, avg(row_idx) AS mr, avg(col_idx) AS mc FROM seg GROUP BY 1, 2),
 cells AS (SELECT frame, label, pixels, most, volume, coalesce(r / nullif(volume, 0), mr) AS centre_row, coalesce(c / nullif(volume, 0), mc) AS centre_col FROM raw),
 placed AS (SELECT *, {PIXEL_KM} * centre_col AS x, {PIXEL_KM} * centre_row AS y, pixels * {PIXEL_KM * PIXEL_KM} AS area FROM cells)"""


def cells_of(frames: DataFrame) -> DataFrame:
    """Cells of the frames with places in km, as the operators of tracking take them."""
    stats = nowcast.cell_stats(nowcast.segment(frames, ECHO, WIDTH), ECHO)
    return stats.select("frame", "label", (F.col("centre_col") * PIXEL_KM).alias("x"), (F.col("centre_row") * PIXEL_KM).alias("y"), (F.col("pixels") * PIXEL_KM**2).alias("area_km2"), F.col("pixels").cast("double").alias("pixels"), "most", "volume")


def tracks_of(frames: DataFrame) -> DataFrame:
    still = F.lit(None).cast("double")
    return tracking.track(cells_of(frames).select(F.lit("a").alias("series"), "*", (F.col("frame") * SECONDS).alias("at"), still.alias("u"), still.alias("v")))


@query("frames", f"{_SEGMENT} SELECT * FROM seg", recursive=True)
def nc_segment(frames):
    return nowcast.segment(frames, ECHO, WIDTH)


@query("frames", f"{_CELLS} SELECT frame, label, pixels, most, round(volume, 5) AS volume, round(centre_row, 5) AS centre_row, round(centre_col, 5) AS centre_col FROM cells WHERE pixels >= 2", recursive=True)
def agg_cell_stats(frames):
    return rounded(nowcast.cell_stats(nowcast.segment(frames, ECHO, WIDTH), ECHO, 2), "volume", "centre_row", "centre_col")


@query("frames", f"""{_CELLS}, e AS (SELECT b.frame, a.label AS was, b.label, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS distance, a.area AS aa, b.area AS ba, a.most AS am, b.most AS bm
  FROM placed a JOIN placed b ON b.frame = a.frame + 1)
 SELECT frame, was, label, round(distance, 4) AS distance, round(distance + 2 * abs(ln(ba / aa)) + 0.15 * abs(bm - am), 4) AS cost FROM e WHERE distance <= {GATE}""", recursive=True)
def join_cell_edges(frames):
    cells = cells_of(frames)
    return rounded(tracking.cell_edges(cells.withColumn("frame", F.col("frame") + 1), cells, GATE), "distance", "cost", digits=4)


@query("frames")
def join_cell_match(frames):
    cells = cells_of(frames)
    return rounded(tracking.match_cells(cells.withColumn("frame", F.col("frame") + 1), cells, GATE), "distance", "cost", digits=4)


@query("frames")
def agg_growth_class(frames):
    cells = cells_of(frames)
    matches = tracking.match_cells(cells.withColumn("frame", F.col("frame") + 1), cells, GATE, similar=False)
    return features.growth_class(cells, matches)


@query("frames")
def agg_object_scores(frames):
    """Cells of persistence against the cells seen a frame later."""
    cells = cells_of(frames)
    return rounded(tracking.object_scores(cells.withColumn("frame", F.col("frame") + 1), cells, GATE), "pod", "far", "csi", "centroid_error")


@query("frames")
def join_two_pass_track(frames):
    return rounded(tracks_of(frames).select("frame", "label", "track", "age", "step", "seconds", "u", "v"), "u", "v")


@query("frames")
def nc_tracks(frames):
    return rounded(tracks_of(frames).select("frame", "label", "track", "age", "net_km", "path_km", "straightness", "deviant", "tendency"), "net_km", "path_km", "straightness", "tendency")


@query("frames")
def win_severity_hysteresis(frames):
    return tracks_of(frames).select("track", "frame", "label", "severity")


@query("frames")
def win_trend_anchor(frames):
    return rounded(tracks_of(frames).select("track", "frame", "growing", "anchor"), "anchor")


_STRIKES = """, s AS (SELECT id, CAST(id % 84 AS INT) AS frame, (lon - 19) * 3 AS x, (lat - 59) * 3.2 AS y FROM strikes)"""


@query("frames strikes", f"""{_CELLS}{_STRIKES},
 hit AS (SELECT s.*, g.label AS own FROM s LEFT JOIN seg g ON g.frame = s.frame AND g.row_idx = floor(s.y / {PIXEL_KM} + 0.5) AND g.col_idx = floor(s.x / {PIXEL_KM} + 0.5)),
 near AS (SELECT h.id, arg_min(p.label, (sqrt(power(h.x - p.x, 2) + power(h.y - p.y, 2)), p.label)) AS label FROM hit h JOIN placed p ON p.frame = h.frame AND sqrt(power(h.x - p.x, 2) + power(h.y - p.y, 2)) <= 10 WHERE own IS NULL GROUP BY 1)
 SELECT h.id, h.frame, coalesce(h.own, n.label, -1) AS label FROM hit h LEFT JOIN near n USING (id)""", recursive=True)
def join_strikes_cells(frames, strikes):
    at = strikes.select("id", (F.col("id") % 84).cast("int").alias("frame"), ((F.col("lon") - 19) * 3).alias("x"), ((F.col("lat") - 59) * 3.2).alias("y"))
    return tracking.strikes_to_cells(at, nowcast.segment(frames, ECHO, WIDTH), cells_of(frames), PIXEL_KM).fillna(-1, "label")  # -1: no cell
