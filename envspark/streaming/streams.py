"""Streams to streams. Sources carry event time; watermarks bound what is remembered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def station_latest(obs: DataFrame) -> DataFrame:
    """Latest row of each station and parameter, continuously (update or complete mode)."""
    return obs.groupBy("station_id", "parameter").agg(F.max(F.struct("time", "seq", "value")).alias("m")).select("station_id", "parameter", "m.time", "m.value")


def period_rolling(obs: DataFrame, length: str, every: str, late: str) -> DataFrame:
    """Sliding windows per station and parameter, final once the watermark has passed (append mode)."""
    seen = obs.withWatermark("time", late).groupBy("station_id", "parameter", F.window("time", length, every).alias("w"))
    return seen.agg(F.sum("value").alias("amount"), F.count("value").alias("n")).select("station_id", "parameter", F.col("w.end").alias("end"), "amount", "n")


def late_data(obs: DataFrame, receipt: str, past: str, future: str) -> DataFrame:
    """Rows no older than past and no more than future ahead of their receipt."""
    return obs.filter((F.col("time") >= F.col(receipt) - F.expr(f"interval {past}")) & (F.col("time") <= F.col(receipt) + F.expr(f"interval {future}")))
