"""Streams over files give what the same rows give in a batch."""

from pyspark.sql import functions as F

from envspark.operators import ingest
from envspark.sources.adapters import view
from envspark.streaming import states, streams

DATA = "/root/testdata/sf0.001"


def _stream(spark, table, folder):
    table.write.parquet(str(folder / "in"))
    return spark.readStream.schema(table.schema).parquet(str(folder / "in"))


def _rows(spark, stream, folder, name, mode):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_dedup(spark, tmp_path):
    table = view(spark, DATA, "notifications").withColumns({"pubtime": F.col("pubtime").cast("timestamp"), "received": F.col("id") * 7919 % 10007})
    table = table.withColumn("id", F.col("id").cast("string")).coalesce(1)
    table = table.withColumn("received", F.timestamp_seconds("received"))
    writer = states.folded(_stream(spark, table, tmp_path), str(tmp_path / "state"), states.dedup_fold(10**6))
    writer.option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted(map(tuple, states.Versions(spark, str(tmp_path / "state")).latest().select("id", "data_id").collect()), key=str)
    assert got == sorted(map(tuple, ingest.only_news(table, "received").select("id", "data_id").collect()), key=str)
    assert len(got) < table.count()


def test_only_news(spark):
    """A copy, an older message and a seen id are dropped; a newer message passes."""
    rows = [("1", "a", 5, 1), ("2", "a", 5, 2), ("3", "a", 4, 3), ("1", "a", 9, 4), ("4", "a", 6, 5), ("5", "b", 1, 6)]
    table = spark.createDataFrame(rows, "id string, data_id string, pubtime long, received long")
    assert sorted(r.id for r in ingest.only_news(table, "received").collect()) == ["1", "4", "5"]


def test_station_latest(spark, tmp_path):
    table = view(spark, DATA, "obs")
    got = _rows(spark, streams.station_latest(_stream(spark, table, tmp_path)), tmp_path, "latest", "complete")
    assert got == sorted(map(tuple, streams.station_latest(table).collect()), key=str)


def test_period_rolling(spark, tmp_path):
    table = view(spark, DATA, "obs").withColumn("time", F.col("time").cast("timestamp"))
    stream = streams.period_rolling(_stream(spark, table, tmp_path), "6 hours", "1 hour", "60 days")
    got = [(*r[:3], round(r[3] or 0, 6), r[4]) for r in _rows(spark, stream, tmp_path, "rolling", "update")]
    whole = streams.period_rolling(table, "6 hours", "1 hour", "60 days").collect()
    assert got == sorted([(*r[:3], round(r[3] or 0, 6), r[4]) for r in whole], key=str)


def test_late_data(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 12:00:00' + make_interval(0, 0, 0, 0, h) AS time, timestamp'2024-01-01 12:00:00' AS got FROM VALUES (-5), (-4), (0), (1), (2) AS t(h)")
    assert streams.late_data(rows, "got", "4 hours", "1 hour").count() == 3
