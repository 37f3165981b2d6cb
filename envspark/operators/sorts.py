"""Orders, pages, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sort_features(df: DataFrame, keys: list[tuple[str, bool]], ident: str) -> DataFrame:
    """Order by keys (name, descending); nulls last either way, ties by id."""
    return df.orderBy(*[F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last() for k, down in keys], ident)


def page_offset(df: DataFrame, keys: list[tuple[str, bool]], ident: str, offset: int, limit: int) -> DataFrame:
    return sort_features(df, keys, ident).offset(offset).limit(limit)


def page_keyset(events: DataFrame, before_time, before_id, limit: int) -> DataFrame:
    """Newest first, strictly before the cursor (time, id)."""
    t = F.lit(before_time).cast("timestamp_ntz")
    return events.filter((F.col("time") < t) | ((F.col("time") == t) & (F.col("id") < before_id))).orderBy(F.desc("time"), F.desc("id")).limit(limit)


def evict(df: DataFrame, capacity: int, group: list[str], worst_first: list) -> DataFrame:
    """The rows that go when a group is over its capacity."""
    own = W.partitionBy(*group)
    ranked = df.withColumn("_n", F.row_number().over(own.orderBy(*worst_first))).withColumn("_c", F.count("*").over(own))
    return ranked.filter(F.col("_n") <= F.col("_c") - capacity).drop("_n", "_c")


def common_times(obs: DataFrame, parameters: list[str]) -> DataFrame:
    """Times that every one of the parameters has."""
    n = obs.filter(F.col("parameter").isin(parameters)).select("time", "parameter").distinct().groupBy("time").count()
    return n.filter(F.col("count") == len(parameters)).select("time")


def ledger_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(frame, change) between ledgers (frame, stamp): add, remove or retime."""
    both = old.withColumnRenamed("stamp", "was").join(new.withColumnRenamed("stamp", "now"), "frame", "full")
    change = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").when(F.col("was") != F.col("now"), "retime")
    return both.select("frame", change.alias("change")).filter("change is not null")


def merge_instants(parts: list[DataFrame]) -> DataFrame:
    """Coverages of several instants as one. Rows that are equal in all columns are one; steps whose values differ all stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
