"""Streams whose state is a table: each micro-batch folds its rows into the last version of the table and writes the next one.

A version lies in a folder of the batch's number below a path that all executors share. A batch that runs again reads the version
before it and writes its own anew, so that a lost executor or driver costs no row and doubles none. What a fold keeps is bounded by
a window or a grace, not by the stream's length. Folds are DataFrame functions, so each has a batch form: one fold of all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from envspark.operators.ingest import only_news
from envspark.operators.nowcast import _saved


class Versions:
    """Numbered versions of a table below a path of any file system of Spark's."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.files.exists(self.root):
            return []
        below = [s.getPath() for s in self.files.listStatus(self.root)]
        done = lambda p: self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(p.getName()) for p in below if p.getName().isdigit() and done(p))

    def before(self, number: int) -> DataFrame | None:
        older = [n for n in self.numbers() if n < number]
        return self.spark.read.parquet(f"{self.path}/{older[-1]}") if older else None

    def latest(self) -> DataFrame | None:
        return self.before(1 << 62)

    def write(self, number: int, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{self.path}/{number}")
        for n in [n for n in self.numbers() if n < number][:-1]:  # the one before stays for a batch that runs again
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
        return self.spark.read.parquet(f"{self.path}/{number}")


def folded(stream: DataFrame, path: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame], then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that makes of the state (None at first) and a batch the next state below path; then gets it with the batch's number."""

    def step(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, path)
        state = versions.write(number, fold(versions.before(number), batch))
        if then:
            then(state, number)

    return stream.writeStream.foreachBatch(step)


# ---------------------------------------------------------------- duplicates


def dedup_fold(window_s: int, receipt: str = "received") -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """State: what passed, with the column fresh for the last batch's; it is forgotten window_s after its receipt (a timestamp)."""

    def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        names = batch.columns
        known = state.select(names) if state is not None else None
        if known is not None:
            since = batch.agg(F.max(receipt).alias("now")).select((F.col("now") - F.expr(f"interval {window_s} seconds")).alias("since"))
            known = known.crossJoin(F.broadcast(since)).filter(f"since is null or {receipt} > since").select(names)
        fresh = only_news(batch, receipt, known).withColumn("fresh", F.lit(True))
        return fresh if known is None else known.withColumn("fresh", F.lit(False)).unionByName(fresh)

    return fold


# ---------------------------------------------------------------- alerts


ALERT_STATE = "kind string, sender string, identifier string, sent timestamp, data_id string, pubtime timestamp, expires timestamp, severity int"


def alert_events(messages: DataFrame) -> DataFrame:
    """Messages as rows of state (ALERT_STATE).

    messages: data_id, pubtime, deletion, sender, identifier, sent, msg_type, expires, severity and references, an array of (sender,
    identifier, sent). Only Alert and Update can be held; of Update and Cancel what they refer to is withdrawn.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    kind = F.lower(F.trim("msg_type"))
    content = messages.filter("not deletion")
    name = ["sender", "identifier", "sent"]
    held = content.filter(kind.isin("alert", "update")).select(F.lit("alert").alias("kind"), *name, "data_id", "pubtime", "expires", "severity")
    member = content.select(F.lit("member").alias("kind"), *name, "data_id", "pubtime", nothing("timestamp").alias("expires"), nothing("int").alias("severity"))
    gone = messages.filter("deletion").select(F.lit("deleted").alias("kind"), *[nothing(k).alias(n) for n, k in zip(name, ("string", "string", "timestamp"))], "data_id", "pubtime", nothing("timestamp").alias("expires"), nothing("int").alias("severity"))
    refer = content.filter(kind.isin("update", "cancel")).select(F.explode("references").alias("r"), "pubtime").select(
        F.lit("withdrawn").alias("kind"), "r.sender", "r.identifier", "r.sent", nothing("string").alias("data_id"), "pubtime", nothing("timestamp").alias("expires"), nothing("int").alias("severity"))
    return held.unionByName(member).unionByName(gone).unionByName(refer)


def alert_fold(grace_s: int) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """State of the alerts so far, one row a fact, whatever order messages came in.

    Of an alert (sender, identifier) the version of the newest pubtime is known (ties: the later sent, then data_id); of a
    withdrawn version, a deleted data_id, and a data_id's versions, the newest pubtime that says so. A version that came under a deleted
    data_id, no later than the deletion, is withdrawn under every other data_id too. grace_s after the newest pubtime of all, facts are
    forgotten; an alert, grace_s after it expires (one that never expires, after its pubtime).
    """

    def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = alert_events(batch) if state is None else state.unionByName(alert_events(batch))
        newest = F.max_by(F.struct("sent", "data_id", "pubtime", "expires", "severity"), F.struct("pubtime", "sent", "data_id"))
        alerts = rows.filter("kind = 'alert'").groupBy("kind", "sender", "identifier").agg(newest.alias("n")).select("kind", "sender", "identifier", "n.sent", "n.data_id", "n.pubtime", "n.expires", "n.severity")
        key = ["kind", "sender", "identifier", "sent", "data_id"]
        facts = rows.filter("kind <> 'alert'").groupBy(key).agg(F.min("pubtime").alias("first"), F.max("pubtime").alias("last"))
        facts = facts.withColumn("pubtime", F.when(F.col("kind") == "member", F.col("first")).otherwise(F.col("last"))).select(*key, "pubtime", F.lit(None).cast("timestamp").alias("expires"), F.lit(None).cast("int").alias("severity"))
        both = _saved(alerts.unionByName(facts))
        gone = both.filter("kind = 'deleted'").select("data_id", F.col("pubtime").alias("until"))
        spread = both.filter("kind = 'member'").join(gone, "data_id").filter("pubtime <= until").select(F.lit("withdrawn").alias("kind"), "sender", "identifier", "sent", F.lit(None).cast("string").alias("data_id"), F.col("until").alias("pubtime"), "expires", "severity")
        withdrawn = both.filter("kind = 'withdrawn'").unionByName(spread).groupBy(key).agg(F.max("pubtime").alias("pubtime")).select(*key, "pubtime", F.lit(None).cast("timestamp").alias("expires"), F.lit(None).cast("int").alias("severity"))
        whole = both.filter("kind <> 'withdrawn'").unionByName(withdrawn)
        since = both.agg((F.max("pubtime") - F.expr(f"interval {grace_s} seconds")).alias("since"))
        stays = F.when(F.col("kind") == "alert", F.coalesce("expires", "pubtime")).otherwise(F.col("pubtime")) >= F.col("since")
        return whole.crossJoin(F.broadcast(since)).filter(stays).drop("since").select([c.split()[0] for c in ALERT_STATE.split(", ")])

    return fold


def held_alerts(state: DataFrame) -> DataFrame:
    """The alerts of a state whose newest version is neither withdrawn nor came under a data_id deleted since."""
    alerts = state.filter("kind = 'alert'").drop("kind")
    gone = state.filter("kind = 'withdrawn'").select("sender", "identifier", "sent", F.col("pubtime").alias("until"))
    deleted = state.filter("kind = 'deleted'").select("data_id", F.col("pubtime").alias("until"))
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}"))
    left = alerts.alias("a").join(gone.alias("g"), same("sender") & same("identifier") & same("sent") & (F.col("a.pubtime") <= F.col("g.until")), "left_anti")
    return left.alias("a").join(deleted.alias("g"), same("data_id") & (F.col("a.pubtime") <= F.col("g.until")), "left_anti")


# ---------------------------------------------------------------- rolling periods


def rolling_fold(length_s: int, resum_after: int = 4) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Sums of each cell's values over the last length_s seconds to the newest frame of all, by adding what comes and taking out what leaves.

    A batch has cell, time and value; a frame that comes again replaces its cell's value. State has rows of kind frame (those in
    the window) and sum (cell, value, n; time: the window's end, since: when it was last summed afresh). After resum_after lengths, sums are made afresh
    from the frames, so that rounding can't build up; the sum of a cell without frames is exactly 0, for as long as the batch in
    which the last one leaves, then the cell goes. Frames that come too late for the window are left out.
    """

    def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.select("cell", F.col("time").cast("timestamp").alias("time"), F.col("value").cast("double").alias("value")).filter("value is not null and time is not null")
        new = new.groupBy("cell", "time").agg(F.max("value").alias("value"))
        if state is None:
            old = new.limit(0)
            sums = new.limit(0).select("cell", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n"))
            since = None
        else:
            old = state.filter("kind = 'frame'").select("cell", "time", "value")
            sums = state.filter("kind = 'sum'").select("cell", "value", "n")
            since = state.filter("kind = 'sum'").agg(F.unix_micros(F.max("since"))).first()[0]
        both = _saved(new.withColumn("k", F.lit(1)).union(old.withColumn("k", F.lit(0))))
        end = both.agg(F.unix_micros(F.max("time"))).first()[0]
        inside = F.unix_micros("time") > F.lit(end).cast("long") - length_s * 1_000_000
        now = both.filter(inside).groupBy("cell", "time").agg(F.max_by("value", "k").alias("value"), F.min("k").alias("k"))
        frames = _saved(now.select("cell", "time", "value"))
        afresh = since is None or end is None or end - since >= resum_after * length_s * 1_000_000
        if afresh:
            since = end
            total = frames.groupBy("cell").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
            total = total.unionByName(sums.filter("n > 0").join(total, "cell", "left_anti").select("cell", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n")))
        else:
            change = frames.select("cell", "time", F.col("value").alias("is")).join(old.select("cell", "time", F.col("value").alias("was")), ["cell", "time"], "full").filter("not (is <=> was)")
            delta = change.groupBy("cell").agg(F.sum(F.coalesce("is", F.lit(0.0))).alias("plus"), F.sum(F.coalesce("was", F.lit(0.0))).alias("minus"), (F.count("is") - F.count("was")).alias("dn"))
            z = lambda c: F.coalesce(F.col(c), F.lit(0))
            total = sums.filter("n > 0").join(delta, "cell", "full").select("cell", (z("value") + z("plus") - z("minus")).alias("value"), (z("n") + z("dn")).alias("n"))
            total = total.select("cell", F.when(F.col("n") > 0, F.col("value")).otherwise(0.0).alias("value"), "n")
        stamp = lambda t: F.timestamp_micros(F.lit(t).cast("long"))
        rows = total.select(F.lit("sum").alias("kind"), "cell", stamp(end).alias("time"), "value", F.col("n").cast("long").alias("n"), stamp(since).alias("since"))
        return rows.union(frames.select(F.lit("frame"), "cell", "time", "value", F.lit(None).cast("long"), F.lit(None).cast("timestamp")))

    return fold
