"""Lapse rate, land mask and index lines by hand."""

import pytest

from envspark.operators import gridding
from envspark.sources import documents


def test_lapse_rate_and_mask(spark):
    stations = spark.createDataFrame([(1, 25.0, 60.0, 100.0), (2, 25.0, 60.0, None)], "station_id int, lon double, lat double, elevation double")
    values = spark.createDataFrame([(1, 10.0), (2, 99.0)], "station_id int, value double")
    cells = spark.createDataFrame([(1, 25.0, 60.0, 1100.0), (2, 25.1, 60.0, 0.0), (3, 25.1, 60.0, None), (4, 0.0, 0.0, 5.0)], "id int, lon double, lat double, height double")
    raised = gridding.with_lapse(cells, stations, values, 50_000.0)
    assert {r["id"]: r["estimate"] and round(r["estimate"], 9) for r in raised.collect()} == {1: 3.5, 2: 10.65, 3: None}
    mask = spark.createDataFrame([(1, 50.0), (2, 49.0)], "id int, land double")
    assert {r["id"]: r["estimate"] and round(r["estimate"], 9) for r in gridding.masked(raised, mask, "%").collect()} == {1: 3.5, 2: None, 3: None}
    with pytest.raises(ValueError, match="land mask"):
        gridding.masked(raised, mask, "m")


def test_json_index_lines(spark):
    line = '{"domain": "g", "date": "20260405", "time": "%s", "step": "%s", %s"param": "q", "_offset": 7, "_length": 9}'
    rows = [("a", 0, "not json"), ("a", 1, line % ("0600", "12", '"levelist": "150", "levtype": "pl", ')), ("a", 2, "  "), ("a", 3, line % ("1800", "3", '"levtype": "sfc", ')), ("b", 1, line % ("xx", "0", '"levtype": "sfc", ')), ("c", 1, line % ("0000", "0-6", '"levelist": "1.5", "levtype": "pl", '))]
    got = [tuple(r) for r in documents.json_index(spark.createDataFrame(rows, "file string, place int, value string")).selectExpr("file", "unix_seconds(reference) % 86400 AS s", "step", "levtype", "level", "offset", "length").orderBy("file", "levtype").collect()]
    assert got == [("a", 21600, 12, "pl", 150, 7, 9), ("a", 21600, 12, "sfc", None, 7, 9), ("c", 0, 0, "pl", None, 7, 9)]
