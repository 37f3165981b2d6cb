"""Window functions and ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def deaccumulate(acc: DataFrame) -> DataFrame:
    """Amount and length of each step of run-start accumulations (run_time, cell, step, acc); the first step is itself, none is negative."""
    order = W.partitionBy("run_time", "cell").orderBy("step")
    first = F.row_number().over(order) == 1
    amount = F.when(first, F.col("acc")).otherwise(F.greatest(F.lit(0.0), F.col("acc") - F.lag("acc").over(order)))
    length = F.col("step") - F.coalesce(F.lag("step").over(order), F.lit(0))
    return acc.select("run_time", "cell", "step", F.when(F.col("acc").isNotNull() & (first | F.lag("acc").over(order).isNotNull()), amount).alias("amount"), length.alias("step_length"))


def frame_weight(frames: DataFrame, cap: int) -> DataFrame:
    """How long each frame counts: the gap to the next one, capped."""
    ledger = frames.select("series", "time").distinct()
    gap = F.unix_seconds(F.lead("time").over(W.partitionBy("series").orderBy("time")).cast("timestamp")) - F.unix_seconds(F.col("time").cast("timestamp"))
    return ledger.select("series", "time", F.least(F.coalesce(gap, F.lit(cap)), F.lit(cap)).cast("long").alias("weight_s"))


def latest_per_key(alerts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row a key; ties go to the first in order."""
    return alerts.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(order[0]), *order[1:]]))).filter("_n = 1").drop("_n")


def latest_run(fields: DataFrame, run: str = "run_time") -> DataFrame:
    last = fields.agg(F.max(run).alias(run))
    return fields.join(F.broadcast(last), run, "left_semi")


def flash_jump(rates: DataFrame, history: int = 6) -> DataFrame:
    """(track, frame, rate, sigma, jump) of rows (track, frame, rate): deviation from up to six frames before, at least two, in their
    standard deviations; a flat history gives 10; a jump is a rate of 10 and more than 2. A missing frame begins the history anew.
    """
    order = W.partitionBy("track").orderBy("frame")
    run = rates.withColumn("gap", (F.col("frame") - F.lag("frame").over(order) != 1).cast("int")).withColumn("run", F.coalesce(F.sum("gap").over(order), F.lit(0)))
    past = W.partitionBy("track", "run").orderBy("frame").rowsBetween(-history, -1)
    s = run.withColumn("m", F.avg("rate").over(past)).withColumn("d", F.stddev_pop("rate").over(past)).withColumn("k", F.count("rate").over(past))
    sigma = F.when(F.col("k") >= 2, F.when(F.col("d") > 0, (F.col("rate") - F.col("m")) / F.col("d")).when(F.col("rate") > F.col("m"), 10.0).otherwise(0.0))
    return s.withColumn("sigma", sigma).select("track", "frame", "rate", "sigma", F.coalesce((F.col("rate") >= 10) & (F.col("sigma") > 2), F.lit(False)).alias("jump"))


def severity_hysteresis(cells: DataFrame) -> DataFrame:
    """(track, frame, severities) over (track, frame, most, area_km2), an array a run of consecutive frames from its first frame.

    A point for each of 45, 50 and 55 dBZ reached and one for 50 km2; 0 to 3 and more points are classes 0 to 3. A class rises
    at once; it falls in one frame, but only as far as the points with 2 dB and 15 % of area of slack allow.
    """

    def points(slack: float, share: float):
        steps = [F.col("most") >= x - slack for x in (45.0, 50.0, 55.0)] + [F.col("area_km2") >= 50.0 * (1 - share)]
        return F.least(sum(F.coalesce(x, F.lit(False)).cast("int") for x in steps), F.lit(3))

    order = W.partitionBy("track").orderBy("frame")
    run = cells.select("track", "frame", points(0.0, 0.0).alias("strict"), points(2.0, 0.15).alias("relaxed"), (F.col("frame") - F.lag("frame").over(order) != 1).cast("int").alias("gap"))
    run = run.withColumn("run", F.coalesce(F.sum("gap").over(order), F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct("frame", "strict", "relaxed")))
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(acc, s):
        now = F.greatest(s["strict"], F.least(acc["held"], s["relaxed"]))
        return F.struct(now.alias("held"), F.concat(acc["out"], F.array(now)).alias("out"))

    return run.groupBy("track", "run").agg(F.min("frame").alias("frame"), ordered.alias("s")).select("track", "frame", F.aggregate("s", start, step, lambda acc: acc["out"]).alias("severities"))


def rank_rounded(df: DataFrame, score: str, digits: int, tie: str, partition: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*partition).orderBy(F.round(score, digits).desc(), tie)))


def kinematics(track_points: DataFrame) -> DataFrame:
    """Per track and frame of planar positions in km: path so far, net displacement, straightness."""
    order = W.partitionBy("track").orderBy("frame")
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    whole = order.rowsBetween(W.unboundedPreceding, 0)
    t = track_points.withColumn("leg", F.coalesce(F.hypot(dx, dy), F.lit(0.0))).withColumn("path", F.sum("leg").over(whole))
    t = t.withColumn("net", F.hypot(F.col("x") - F.first("x").over(whole), F.col("y") - F.first("y").over(whole)))
    return t.select("track", "frame", "path", "net", F.try_divide("net", "path").alias("straightness"))
