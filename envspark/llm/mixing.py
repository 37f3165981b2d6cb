"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is bisected until the weights
have a target entropy, or until no source is repeated more than a limit allows. Weights become documents by block
permutations: a source's documents are dealt to blocks by a hash, the source's blocks are permuted by another, documents within
a block by the first, and a source's budget of tokens takes whole passes over that order and then a last, partial one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import saved

#: Exponents that one pass over the sources compares, and passes: each narrows the interval 32 times.
GRID, PASSES = 33, 8
#: Documents of a source are dealt to so many blocks.
BLOCKS = 4096


def order_key(name: str, seed: int):
    """60 hash bits of an id as a number, the same in any engine that has MD5; of a null id null."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string"))), 1, 15), 16, 10).cast("long")


def tokens(documents: DataFrame, text: str = "text"):
    """Words between white space; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, "[ \t-\r]+"))).cast("long")


def weights(sources: DataFrame, entropy_share: float, repeat_limit: float, budget_share: float) -> DataFrame:
    """(source, tokens, share, exponent, weight) from (source, tokens).

    The exponent is the largest in [0, 1] whose weights have an entropy of at least entropy_share of the most possible, and then
    raised, if need be, until budget_share * weight / share <= repeat_limit for every source. No source is collected: every pass
    compares GRID exponents in one aggregate. Sources without tokens have weight 0.
    """
    total = sources.agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("tokens") > 0, 1)).alias("n"))
    shares = saved(sources.crossJoin(F.broadcast(total)).select("source", "tokens", "n", F.when(F.col("tokens") > 0, F.col("tokens") / F.col("all")).alias("share")))

    def narrow(holds) -> float:
        """The interval [low, high] shrinks to the border between exponents that hold (above) and that don't."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
            at = holds(grid)
            if at is None:
                return high
            low, high = grid[max(at - 1, 0)], grid[at]
        return high

    def table(grid: list[float]) -> DataFrame:
        cells = shares.filter("share > 0").select("share", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("e")) for i, g in enumerate(grid)])).alias("g")).select("share", "n", "g.*")
        return cells.groupBy("i", "e").agg(F.sum(F.pow("share", F.col("e"))).alias("z"), F.sum(F.pow("share", F.col("e")) * F.ln("share")).alias("s"), F.max(F.pow("share", F.col("e") - 1)).alias("most"), F.max("n").alias("n"))

    def repeats_held(grid: list[float]) -> int | None:
        good = [r["i"] for r in table(grid).filter(F.col("most") / F.col("z") * budget_share <= repeat_limit).select("i").collect()]
        return min(good) if good else None

    def entropy_lost(grid: list[float]) -> int | None:
        # entropy falls with the exponent; the first one that is too low
        cost = F.ln("z") - F.col("e") * F.col("s") / F.col("z")
        bad = [r["i"] for r in table(grid).filter(cost < entropy_share * F.ln("n") - 1e-12).select("i").collect()]
        return min(bad) if bad else None

    if not shares.filter("share > 0").limit(1).count():
        exponent = 1.0
    else:
        exponent = max(narrow(entropy_lost), narrow(repeats_held))
    powered = shares.withColumn("p", F.coalesce(F.pow("share", F.lit(exponent)), F.lit(0.0)))
    z = powered.agg(F.sum("p").alias("z"))
    return powered.crossJoin(F.broadcast(z)).select("source", "tokens", F.coalesce("share", F.lit(0.0)).alias("share"), F.lit(exponent).alias("exponent"), F.coalesce(F.col("p") / F.col("z"), F.lit(0.0)).alias("weight"))


def mix(documents: DataFrame, entropy_share: float = 0.98, repeat_limit: float = 4.0, budget_share: float = 1.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, weight, copies, position) of the documents that are drawn at least once.

    budget_share is the token budget as a share of all tokens. A source gets budget * weight tokens: copies is how often a
    document is drawn, whole passes and one more where it begins before the rest of the budget ends; position is its first token's place in
    the source's order. A null source is a source of its own, '' in the result. Texts without tokens are drawn by whole passes
    only. Repeated rows are documents each; rows without doc_id are ordered by a hash of their text. An empty table gives an empty result.
    """
    rows = saved(documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens(documents).alias("n_tokens"), F.coalesce(order_key("doc_id", seed), order_key("text", seed), F.lit(0)).alias("key")))
    rows = rows.withColumn("block", F.col("key") % BLOCKS)
    per = saved(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    weight = weights(per.groupBy("source").agg(F.sum("tokens").alias("tokens")), entropy_share, repeat_limit, budget_share)
    per = per.withColumn("turn", F.md5(F.concat_ws(":", F.lit(seed), F.col("block"), F.col("source"))))
    running = W.partitionBy("source").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, -1)
    begins = per.select("source", "block", F.coalesce(F.sum("tokens").over(running), F.lit(0)).alias("begin"))
    within = W.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    total = weight.agg(F.sum("tokens").alias("all"))
    plan = weight.crossJoin(F.broadcast(total)).select("source", "weight", "tokens", F.floor(F.lit(budget_share) * F.col("all") * F.col("weight")).alias("budget"))
    plan = plan.select("source", "weight", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).alias("passes"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"))
    drawn = placed.join(begins, ["source", "block"]).join(plan, "source").withColumn("position", F.col("begin") + F.col("inside"))
    copies = (F.col("passes") + F.when((F.col("position") < F.col("rest")) & (F.col("n_tokens") > 0), 1).otherwise(0)).cast("long")
    return drawn.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), copies.alias("copies"), F.col("position").cast("long").alias("position")).filter("copies > 0")
