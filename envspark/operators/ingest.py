"""Upkeep of report tables in batches: replacement, retention, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.operators.nowcast import _saved


def upsert_reports(reports: DataFrame, keys: list[str], received: str) -> DataFrame:
    """Of reports with the same keys the one received last."""
    rest = [c for c in reports.columns if c not in keys]
    last = reports.groupBy(keys).agg(F.max_by(F.struct(*rest), received).alias("r"))
    return last.select(*keys, "r.*")


def retention(reports: DataFrame, newest: Column, length: str, stations: int) -> DataFrame:
    """Reports no older than length, of the stations most recently heard from (ties: the smaller station_id)."""
    kept = reports.filter(F.col("time") >= newest - F.expr(f"interval {length}"))
    heard = kept.groupBy("station_id").agg(F.max("time").alias("last")).orderBy(F.desc("last"), "station_id").limit(stations)
    return kept.join(heard.select("station_id"), "station_id", "left_semi").select(reports.columns)


def staleness(reports: DataFrame, keys: list[str], now: Column, expected_minutes: float) -> DataFrame:
    """Minutes since the newest row of each key, and whether that is more than twice the expected interval."""
    age = (F.unix_micros(now) - F.unix_micros(F.max("time").cast("timestamp"))) / 60_000_000
    return reports.groupBy(keys).agg(age.alias("age_min")).withColumn("stale", F.col("age_min") > 2 * expected_minutes)


def only_news(notifications: DataFrame, receipt: str, known: DataFrame | None = None) -> DataFrame:
    """The messages (id, data_id, pubtime, receipt and more) that are news, in order of receipt and id.

    A message passes if none with its id has passed, whatever its data_id, and its pubtime is newer than all that passed of its
    data_id. A repeat of an id may pass where the one before it was stale. known has messages that passed earlier. Whether an id is taken
    depends on earlier messages only, so that passes over the whole settle it from the first message on, in as many as ids wait for one another.
    """
    names = notifications.columns
    rows = notifications.withColumn("_old", F.lit(False))
    if known is not None:
        rows = rows.unionByName(known.select(names).withColumn("_old", F.lit(True)))
    order = [F.desc("_old"), receipt, "id", "pubtime", "data_id"]
    by_data = W.partitionBy("data_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    by_id = W.partitionBy("id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    state = _saved(rows.withColumn("_taken", F.lit(False)))
    while True:
        newest = F.max(F.when(~F.col("_taken") | F.col("_old"), F.col("pubtime"))).over(by_data)
        news = state.withColumn("_passes", F.col("_old") | (~F.col("_taken") & F.coalesce(F.col("pubtime") > newest, F.lit(True))))
        after = _saved(news.withColumn("_now", ~F.col("_old") & F.coalesce(F.max("_passes").over(by_id), F.lit(False))))
        if not after.filter("_now <> _taken").limit(1).count():
            return after.filter("_passes and not _old").select(names)
        state = after.select(*names, "_old", F.col("_now").alias("_taken"))
