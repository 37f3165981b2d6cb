"""Aggregations; each combines on the map side."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def temporal_extent(obs: DataFrame) -> DataFrame:
    return obs.agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def spatial_extent(points: DataFrame) -> DataFrame:
    """A box measured from one point's longitude, so it may come out with west > east; a full turn is -180 to 180."""
    ref = points.filter("lon is not null").agg(F.min("lon").alias("ref"))
    off = F.pmod(F.col("lon") - F.col("ref") + 180.0, F.lit(360.0)) - 180.0
    box = points.crossJoin(F.broadcast(ref)).withColumn("off", off).agg(F.min("off").alias("a"), F.max("off").alias("b"), F.first("ref").alias("ref"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    wrap = lambda c: F.pmod(c + 180.0, F.lit(360.0)) - 180.0
    full = F.col("b") - F.col("a") >= 360
    return box.select(F.when(full, -180.0).otherwise(wrap(F.col("ref") + F.col("a"))).alias("west"), "south", F.when(full, 180.0).otherwise(wrap(F.col("ref") + F.col("b"))).alias("east"), "north")


def station_summary(obs: DataFrame) -> DataFrame:
    return obs.groupBy("station_id").agg(F.min("time").alias("first_report"), F.max("time").alias("last_report"), F.count("*").alias("report_count"), F.max_by("parameter", F.struct("time", "seq")).alias("last_parameter"))


def cadence(obs: DataFrame, newest: int = 12) -> DataFrame:
    """(station_id, cadence_s): upper median of the newest positive gaps between distinct report times."""
    order = W.partitionBy("station_id").orderBy("time")
    times = obs.select("station_id", "time").distinct()
    gaps = times.withColumn("gap", F.unix_seconds(F.col("time").cast("timestamp")) - F.unix_seconds(F.lag("time").over(order).cast("timestamp"))).filter("gap > 0")
    gaps = gaps.withColumn("n", F.row_number().over(W.partitionBy("station_id").orderBy(F.desc("time")))).filter(F.col("n") <= newest)
    ranked = gaps.withColumn("r", F.row_number().over(W.partitionBy("station_id").orderBy("gap"))).withColumn("c", F.count("*").over(W.partitionBy("station_id")))
    return ranked.filter("r = floor(c / 2) + 1").select("station_id", F.col("gap").cast("long").alias("cadence_s"))


def regular_step(times: DataFrame, key: str, slack_s: int = 2) -> DataFrame:
    """(key, step_s): the rounded mean gap where gaps differ by slack at most, else null."""
    order = W.partitionBy(key).orderBy("time")
    gap = F.unix_seconds(F.col("time").cast("timestamp")) - F.unix_seconds(F.lag("time").over(order).cast("timestamp"))
    gaps = times.select(key, "time").distinct().withColumn("gap", gap).filter("gap is not null")
    return gaps.groupBy(key).agg(F.when(F.max("gap") - F.min("gap") <= slack_s, F.round(F.avg("gap"))).cast("long").alias("step_s"))


def period(frames: DataFrame, length: int, cap: int, threshold: float) -> DataFrame:
    """Windows (frame - length, frame] of every frame, per cell: amount, mean, count above, valid share; null is skipped.

    A frame counts for the gap to the next frame, capped; frames are the steps of one ledger, some thousand rows.
    """
    ledger = frames.select("frame").distinct()
    weight = ledger.withColumn("weight", F.least(F.coalesce(F.lead("frame").over(W.orderBy("frame")) - F.col("frame"), F.lit(cap)), F.lit(cap)))
    member = weight.select("frame", "weight", F.explode(F.sequence(F.col("frame"), F.col("frame") + length - 1)).alias("end")).join(ledger.withColumnRenamed("frame", "end"), "end", "left_semi")
    total = member.groupBy("end").agg(F.count("*").alias("n_frames"), F.sum("weight").alias("counted"))
    out = frames.join(F.broadcast(member), "frame").groupBy("end", "row_idx", "col_idx").agg(
        F.sum(F.col("value") * F.col("weight")).alias("amount"), F.avg("value").alias("mean"), F.count_if(F.col("value") >= threshold).alias("n_above"), F.count("value").alias("valid")
    )
    return out.join(F.broadcast(total), "end").select("end", "row_idx", "col_idx", "amount", "mean", "n_above", (F.col("valid") / F.col("n_frames")).alias("cell_coverage"), F.least(F.lit(1.0), F.col("counted") / length).alias("window_coverage"))


def contingency(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Of (forecast, analysis) rows: counts and scores a threshold; undefined scores are null."""
    each = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    f, a = F.col("forecast") >= F.col("threshold"), F.col("analysis") >= F.col("threshold")
    n = each.groupBy("threshold").agg(F.count_if(f & a).alias("hits"), F.count_if(~f & a).alias("misses"), F.count_if(f & ~a).alias("false_alarms"), F.count_if(~f & ~a).alias("correct_negatives"))
    share = lambda top, *under: F.try_divide(F.col(top).cast("double"), sum((F.col(u) for u in under[1:]), F.col(under[0])).cast("double"))
    return n.select("*", share("hits", "hits", "misses").alias("pod"), share("false_alarms", "hits", "false_alarms").alias("far"), share("hits", "hits", "misses", "false_alarms").alias("csi"))


def columns(gates: DataFrame, height: Column, threshold: float = 35.0) -> DataFrame:
    """Per (site, azimuth, range_idx): column maximum, echo top and vertically integrated liquid (capped at 56 dBZ)."""
    z = F.pow(F.lit(10.0), F.least(F.col("dbz"), F.lit(56.0)) / 10)
    top = gates.groupBy("site", "azimuth", "range_idx", "elangle").agg(F.max("dbz").alias("dbz")).withColumn("h", height)
    nxt = F.lead("h").over(W.partitionBy("site", "azimuth", "range_idx").orderBy("elangle"))
    lwc = top.withColumn("deep", F.coalesce(nxt - F.col("h"), F.lit(0.0))).withColumn("vil", 3.44e-6 * F.pow(z, F.lit(4 / 7)) * F.col("deep"))
    return lwc.groupBy("site", "azimuth", "range_idx").agg(F.max("dbz").alias("colmax"), F.max(F.when(F.col("dbz") >= threshold, F.col("h"))).alias("echo_top_m"), F.sum("vil").alias("vil"))


def lightning(strikes: DataFrame, minutes: int = 60) -> DataFrame:
    """Per window: counts, rate a minute, cloud and ground parts, share of positive ground strikes; unknown is neither."""
    ground = F.col("cloud_indicator") == 0
    start = F.window(F.col("time").cast("timestamp"), f"{minutes} minutes")["start"].cast("timestamp_ntz")
    n = strikes.groupBy(start.alias("start")).agg(
        F.count("*").alias("n"), F.count_if(ground).alias("ground"), F.count_if(F.col("cloud_indicator") == 1).alias("cloud"), F.count_if(ground & (F.col("peak_current_ka") > 0)).alias("positive")
    )
    return n.select("start", "n", (F.col("n") / minutes).alias("rate"), "ground", "cloud", F.try_divide(F.col("positive").cast("double"), F.col("ground").cast("double")).alias("positive_share"))


def fingerprint(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows and content hash of each slice, whatever the order of its rows; repeated rows and the places of nulls count."""
    row = F.xxhash64(*values, *[F.col(v).isNull() for v in values])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("fingerprint"))


def obs_fingerprint(obs: DataFrame) -> DataFrame:
    return obs.groupBy("parameter").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


def _cover(tiers: list[tuple[Iterable[tuple[int, int]], bool]], now: int, room: int) -> list[int]:
    """Of each tier's (onset, earliest end), latest onset first, the onsets that put an instant into every window, while there is room."""
    kept: list[int] = []
    for windows, all_fit in tiers:
        chosen: list[int] = []
        for onset, end in windows:
            if not (chosen and chosen[-1] <= end) and not any(onset <= t <= end for t in kept):
                chosen.append(onset)
        if all_fit and len(chosen) > room:
            continue
        kept += sorted(chosen, key=lambda t: (abs(t - now), t))[: room - len(kept)]
        if all_fit:
            break
    return kept


def _instants(mine: pa.Table, now: int, room: int) -> list[int]:
    """The onsets that _cover keeps of windows (ended, severity, onset, e), of which there may be millions: only columns of numbers are held."""
    ended, severity, onset, end = (mine.column(c).to_numpy() for c in ("ended", "severity", "onset", "e"))

    def latest_first(of: np.ndarray) -> Iterator[tuple[int, int]]:
        rows = of[np.lexsort((end[of], -onset[of]))]
        rows = rows[np.concatenate([[True], onset[rows][1:] != onset[rows][:-1]])] if len(rows) else rows  # an onset's earliest end
        for i in range(0, len(rows), 65536):
            part = rows[i : i + 65536]
            yield from zip(onset[part].tolist(), end[part].tolist())

    tiers = sorted((e, -s) for e in (False, True) for s in np.unique(severity[ended == e]).tolist())
    ordered = [(latest_first(np.arange(len(onset))), True)] + [(latest_first(np.flatnonzero((ended == e) & (severity == -s))), False) for e, s in tiers]
    return _cover(ordered, now, room)


def alert_times(alerts: DataFrame, now: Column, limit: int = 256) -> DataFrame:
    """(time): the instants to offer of alerts (start, end, severity; open ends are null): now, and every boundary up to seven days ahead.

    Over limit, now stays, then every window gets an instant: its onset (an open start's end), the latest first, unless a later one
    lies in it. Where even these are too many, windows still to come go before those that ended, the severer first, the onsets
    nearest to now first. Boundaries nearest to now (ties: the earlier) fill the rest. The windows are reduced to one row an onset second
    and severity, and these meet in one task; no more are there than seconds that the alerts span.
    """
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    at, horizon = seconds(now), seconds(now) + 7 * 86400
    edges = alerts.select(F.explode(F.array("start", "end")).alias("time")).filter("time is not null").select(seconds(F.col("time")).alias("t"))
    bounds = edges.filter(F.col("t") <= horizon).union(alerts.sparkSession.range(1).select(at)).distinct()
    onset, end = seconds(F.coalesce("start", "end")), F.coalesce(seconds(F.col("end")), F.lit(1 << 62))
    w = alerts.filter("coalesce(start, end) is not null and coalesce(start <= end, true)").select(onset.alias("onset"), seconds(F.col("start")).alias("s"), end.alias("e"), F.coalesce("severity", F.lit(0)).alias("severity"))
    w = w.filter((F.col("onset") <= horizon) & ~(F.coalesce(F.col("s") <= at, F.lit(True)) & (at <= F.col("e"))))
    w = w.groupBy((F.col("e") < at).alias("ended"), "severity", "onset").agg(F.min("e").alias("e"))

    def run(mine: pa.Table) -> pa.Table:
        return pa.table({"t": pa.array(_instants(mine, now_s, limit - 1), pa.int64())})

    now_s = alerts.sparkSession.range(1).select(at).first()[0]
    cover = w.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "t long")
    first = F.when(F.col("t") == at, 0).when(F.col("c").isNotNull(), 1).otherwise(2)
    ranked = bounds.join(F.broadcast(cover.select("t", F.lit(1).alias("c"))), "t", "left").select("t", first.alias("k"), F.abs(F.col("t") - at).alias("gap"))
    return ranked.orderBy("k", "gap", "t").limit(limit).select(F.timestamp_seconds("t").cast("timestamp_ntz").alias("time"))


def severity_cells(areas: DataFrame, west: float, south: float, step: float) -> DataFrame:
    """Highest severity of each grid cell whose centre lies in an area (box west, south, east, north; severity), edges included.

    Areas of one box are merged first, so that the cells of a box are made once however many alerts it has.
    """
    boxes = areas.groupBy("west", "south", "east", "north").agg(F.max("severity").alias("severity"))
    first = lambda low, start: F.ceil((F.col(low) - start) / step - 0.5)
    last = lambda high, start: F.floor((F.col(high) - start) / step - 0.5)
    span = lambda low, high, start: F.when(first(low, start) <= last(high, start), F.sequence(first(low, start), last(high, start)))
    cells = boxes.withColumn("row_idx", F.explode(span("south", "north", south))).withColumn("col_idx", F.explode(span("west", "east", west)))
    return cells.groupBy("row_idx", "col_idx").agg(F.max("severity").alias("severity"))
