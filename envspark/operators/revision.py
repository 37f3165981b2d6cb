"""Gridded fields that are computed again only for the times whose stations changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.operators.aggregates import fingerprint
from envspark.operators.gridding import _weighted
from envspark.operators.joins import within
from envspark.operators.nowcast import _saved
from envspark.streaming.states import Versions


def at_times(targets: DataFrame, stations: DataFrame, values: DataFrame, metres: float, k: int = 8, power: float = 2.0) -> DataFrame:
    """(time, id, estimate, neighbours, nearest) at targets (id, lon, lat) from the stations that have a value (time, station_id, value) at a time.

    Distances are worked out once for all times. A target without a station within reach has no row at that time; null or NaN values count as absent.
    """
    there = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("time").isNotNull())
    near = within(targets, stations, metres).join(there.select("time", "station_id", "value"), "station_id")
    found = _weighted(near.withColumn("id", F.struct("time", "id")), k, power)
    return found.select("id.time", "id.id", "estimate", "neighbours", "nearest")


#: Fixed value: how many analysis times are kept, the latest ones.
TIMES = 10_000


def analysis_times(values: DataFrame, cadence_s: int | None = None, most: int = TIMES) -> DataFrame:
    """(time) to compute fields for: every whole cadence (seconds since 1970) from the first to the last of values' times (timestamps), or the times themselves; the latest most of them.

    Without a time, or without a whole cadence between the first and the last, there is no row.
    """
    if cadence_s is None:
        return values.select("time").filter("time is not null").distinct().orderBy(F.desc("time")).limit(most)
    second = F.col("time").cast("timestamp")
    span = values.agg(F.ceil(F.min(F.floor(second.cast("double"))) / cadence_s).alias("first"), F.floor(F.max(F.floor(second.cast("double"))) / cadence_s).alias("last"))
    steps = span.filter("first <= last").select(F.explode(F.sequence(F.greatest(F.col("first"), F.col("last") - (most - 1)), F.col("last"))).alias("n"))
    return steps.select(F.timestamp_seconds(F.col("n") * cadence_s).cast(values.schema["time"].dataType).alias("time"))


def inputs(stations: DataFrame, values: DataFrame) -> DataFrame:
    """(time, n, fingerprint) of what each time's field is computed from: places and values, in whatever order they come."""
    there = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("time").isNotNull())
    return fingerprint(there.join(stations.select("station_id", "lon", "lat"), "station_id"), ["time"], ["station_id", "lon", "lat", "value"])


def changed_times(now: DataFrame, before: DataFrame) -> DataFrame:
    """(time) of inputs that are new or differ from those of before."""
    same = before.select("time", F.col("n").alias("_n"), F.col("fingerprint").alias("_f"))
    return now.join(same, "time", "left").filter("_f is null or _n <> n or _f <> fingerprint").select("time")


def revise(spark: SparkSession, path: str, targets: DataFrame, stations: DataFrame, values: DataFrame, metres: float, k: int = 8, power: float = 2.0) -> DataFrame:
    """Brings the fields below path up to date and returns the times (time) that were computed.

    Files of unchanged times are not touched. The ledger of inputs is written after the fields, so that a run that broke off is made good by
    the next. A time whose stations are all gone leaves the ledger, and current() doesn't return it any more.
    """
    ledger, now = Versions(spark, f"{path}/ledger"), _saved(inputs(stations, values))
    before = ledger.latest()
    times = now.select("time") if before is None else changed_times(now, before)
    times = _saved(times)
    fields = at_times(targets, stations, values.join(times, "time", "left_semi"), metres, k, power)
    # a time whose targets all lost their stations must lose its old rows too: one row without an id keeps its place
    marked = fields.unionByName(times.select("time"), allowMissingColumns=True)
    marked.hint("rebalance", "time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("time").parquet(f"{path}/fields")
    ledger.write((ledger.numbers() or [0])[-1] + 1, now)
    return times


def current(spark: SparkSession, path: str) -> DataFrame:
    """(time, id, estimate, neighbours, nearest) of the fields below path whose times the ledger holds."""
    ledger = Versions(spark, f"{path}/ledger").latest()
    if ledger is None:
        raise ValueError(f"no fields below {path}")
    kind = ledger.schema["time"].dataType.simpleString()
    base = spark.read.parquet(f"{path}/fields").schema
    ddl = ", ".join(f"{f.name} {kind if f.name == 'time' else f.dataType.simpleString()}" for f in base)
    return spark.read.schema(ddl).parquet(f"{path}/fields").filter("id is not null").join(ledger.select("time"), "time", "left_semi")
