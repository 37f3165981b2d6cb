"""Report elements and file names by hand."""

import datetime
import math

import pytest

from envspark.sources import catalog, reports

ELEMENTS = "station_id string, time int, report int, ord int, lon double, lat double, elevation double, code string, value double, period_hours double"
RULES = [reports.Rule("t", ("b", "a"), offset=-273.0), reports.Rule("rain", ("r",), 12.0), reports.Rule("any", ("r",), scale=2.0)]


def rows(spark, elements):
    return {(r["station_id"], r["time"]): r.asDict() for r in reports.extract(spark.createDataFrame(elements, ELEMENTS), RULES).collect()}


def test_first_code_with_a_value_and_periods(spark):
    at = lambda o, code, value, period=None, s="x": (s, 1, 1, o, 20.0, 60.0, None, code, value, period)
    got = rows(spark, [at(1, "a", 280.0), at(2, "b", None), at(3, "b", math.nan), at(4, "b", 290.0), at(5, "b", 300.0), at(1, "r", 7.0), at(2, "r", 1.0, 11.75), at(3, "r", 2.0, 12.2), at(4, "r", 3.0, 12.0), at(1, "a", 281.0, s="y"), at(1, "zz", 1.0, s="z"), at(1, "a", 1.0, s=None)])
    x = got["x", 1]
    assert (x["t"], x["rain"], x["any"]) == (17.0, 2.0, 14.0)  # a quarter of an hour off is too far
    assert got["y", 1]["t"] == 8.0 and got["z", 1]["t"] is None and len(got) == 3


def test_reports_of_one_place_are_one_and_the_last_place_counts(spark):
    at = lambda r, lat, code, value, height=None, s="x", lon=20.0: (s, 1, r, 1, lon, lat, height, code, value, None)
    got = rows(spark, [
        at(1, 60.0, "a", 280.0), at(2, 60.005, "b", 290.0, 5.0), at(3, 60.009, "a", 270.0, 9.0),
        at(1, 60.0, "a", 280.0, s="ship"), at(2, 61.0, "b", 290.0, s="ship"), at(3, 61.005, "a", 1.0, s="ship"), at(4, 61.005, "r", 4.0, s="ship"),
        at(1, 60.0, "b", 280.0, s="drift"), at(2, 60.008, "a", 274.0, s="drift"), at(3, 60.016, "a", 275.0, s="drift"),
        at(1, 60.0, "a", 280.0, s="back"), at(2, 61.0, "r", 1.0, s="back"), at(3, 60.0, "r", 5.0, s="back")])
    assert (got["x", 1]["t"], got["x", 1]["elevation"], got["x", 1]["lat"]) == (17.0, 5.0, 60.0)
    assert (got["ship", 1]["t"], got["ship", 1]["any"], got["ship", 1]["lat"]) == (17.0, 8.0, 61.0)
    assert got["drift", 1]["t"] == 2.0 and got["drift", 1]["lat"] == 60.016  # too far from the first, near as the second is
    assert got["back", 1]["t"] is None and got["back", 1]["any"] == 10.0
    assert rows(spark, []) == {}


def listed(spark, keys, template, **limits):
    files = spark.createDataFrame([(k, i + 1, "x") for i, k in enumerate(keys)], "key string, bytes long, time string")
    return sorted(((r["time"], r["lead"], r["key"]) for r in catalog.catalog(files, template, **limits).collect()), key=lambda r: (r[0], str(r[1]).zfill(4), r[2]))


def test_names_times_and_leads(spark):
    day = datetime.datetime(2024, 2, 29, 6)
    keys = ["a/m_05_20240229T06Z.nc", "b/m_05_20240229T06Z.nc", "m_07_20240229T06Z.nc", "m_07_20230229T06Z.nc", "m_07_20240229T24Z.nc", "m_5_20240229T06Z.nc", "m_05_20240229T06Z.nc.tmp", "xm_05_20240229T06Z.nc", "m_05_20240229T06Zqnc", None]
    assert listed(spark, keys, "m_{lead}_%Y%m%dT{run}Z.nc") == [(day, 5, "b/m_05_20240229T06Z.nc"), (day, 7, "m_07_20240229T06Z.nc")]
    assert listed(spark, ["2024366.x", "2023366.x", "2024000.x", "2024060.x"], "%Y%j.x") == [(datetime.datetime(2024, 2, 29), None, "2024060.x"), (datetime.datetime(2024, 12, 31), None, "2024366.x")]
    assert listed(spark, ["r(1)+2024-01-02_03:04:05"], "r(1)+%Y-%m-%d_%H:%M:%S") == [(datetime.datetime(2024, 1, 2, 3, 4, 5), None, "r(1)+2024-01-02_03:04:05")]


def test_exclusions_windows_and_the_newest(spark):
    keys = [f"{d:02d}_{h:02d}_2024010{d}.h5" for d in range(1, 6) for h in (0, 1)] + [".9_2024.h5"]
    take = lambda **limits: [k for _, _, k in listed(spark, keys, "%m_{lead}_%Y010%d.h5".replace("%m", "%H").replace("010%d", "%m%d"), **limits)]
    assert len(take()) == 10
    assert take(exclude=["*.h5"]) == [] and len(take(exclude=["01_00_20240101.h5", ".*", "*.part", "01_00"])) == 9
    assert take(start="2024-01-03 03:00:00", end="2024-01-04 04:00:00") == keys[4:8]
    assert take(newest=2) == keys[6:10] and take(most_bytes=3) == keys[:3]


@pytest.mark.parametrize("template", ["x.nc", "%Y%m.nc", "%Y%m%d%q", "%Y%m%d_%Y", "%Y%m%d_{lead}_{lead}", "{run}_%Y%m%d%H"])
def test_templates_that_say_no_time(template):
    with pytest.raises(ValueError):
        catalog.pattern(template)
