"""Significance of cells: a graded mean, bonuses that fill what it leaves, discounts that take from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term(name: str, weight: float, value: Column, bonus: bool = False) -> Column:
    """One input of score: a value of 0 to 1 (null: not measured) with its weight; a bonus of negative weight is a discount."""
    inside = F.when(F.isnan(value), 0.0).when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return F.struct(F.lit(name).alias("term"), F.lit(float(weight)).alias("weight"), F.lit(bonus).alias("bonus"), inside.cast("double").alias("value"))


def _total(array: Column, of) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + of(x))


def _kept(array: Column) -> Column:
    return F.aggregate(array, F.lit(1.0), lambda acc, x: acc * (1.0 - x["pull"]))


def score(df: DataFrame, terms: list[Column], reasons: int = 3) -> DataFrame:
    """df with score and its first reasons (term, value), largest absolute value first, then by name.

    Terms that aren't measured or weigh nothing don't count. Without a graded term the score is 0, whatever bonuses there are, and has
    no reasons. The values of all terms sum to the score before it is cut to 0 to 1.
    """
    have = F.filter(F.array(*terms), lambda x: x["value"].isNotNull() & (x["weight"] != 0))
    df = df.withColumn("_terms", have)
    graded = F.filter("_terms", lambda x: ~x["bonus"])
    df = df.withColumn("_mass", _total(graded, lambda x: F.abs(x["weight"])))
    part = lambda x, pull: F.struct(x["term"].alias("term"), pull.alias("pull"))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    mass = F.nullif(F.col("_mass"), F.lit(0.0))
    df = df.withColumns({
        "_mean": F.transform(graded, lambda x: part(x, x["weight"] * x["value"] / mass)),
        "_pulls": F.transform(F.filter("_terms", lambda x: x["bonus"] & (x["weight"] > 0)), lambda x: part(x, unit(x["weight"] * x["value"] / mass))),
        "_cuts": F.transform(F.filter("_terms", lambda x: x["bonus"] & (x["weight"] < 0)), lambda x: part(x, unit(-x["weight"] * x["value"]))),
    })
    base = unit(_total(F.col("_mean"), lambda x: x["pull"]))
    df = df.withColumn("_filled", (1.0 - base) * (1.0 - _kept(F.col("_pulls"))))
    df = df.withColumn("_removed", (base + F.col("_filled")) * (1.0 - _kept(F.col("_cuts"))))
    share = lambda name, amount: F.transform(
        name, lambda x: part(x, F.coalesce(F.try_divide(amount * x["pull"], _total(F.col(name), lambda y: y["pull"])), F.lit(0.0)))
    )
    said = F.concat("_mean", share("_pulls", F.col("_filled")), share("_cuts", -F.col("_removed")))
    ordered = F.array_sort(F.transform(said, lambda x: F.struct((-F.abs(x["pull"])).alias("size"), x["term"].alias("term"), x["pull"].alias("value"))))
    first = F.transform(F.slice(ordered, 1, reasons), lambda x: F.struct(x["term"].alias("term"), x["value"].alias("value")))
    measured = F.col("_mass") > 0
    df = df.withColumns({
        "score": F.when(measured, unit(_total(said, lambda x: x["pull"]))).otherwise(0.0),
        "reasons": F.when(measured, first).otherwise(F.slice(first, 1, 0)),
    })
    return df.drop("_terms", "_mass", "_mean", "_pulls", "_cuts", "_filled", "_removed")


def most_significant(cells: DataFrame, k: int, tie: str) -> DataFrame:
    """The k cells of the largest score; ties go to the smaller tie."""
    return cells.orderBy(F.desc("score"), tie).limit(k)
