"""Areas that moving cells meet, by hand."""

import pytest

from envspark.operators import impact


def test_over_approaching_and_nothing(spark):
    square = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    areas = spark.createDataFrame([(1, 0.8, [square(0.0, 0.0, 1.0, 1.0)]), (2, 0.5, [square(0.5, 0.5, 2.0, 1.0)]), (3, 1.0, [square(3.0, 0.0, 3.5, 1.0)])], "area_id int, weight double, rings array<array<struct<x:double,y:double>>>")
    degree = 111_194.93
    rows = [(1, 0.4, 0.2, 10.0, None), (2, 0.6, 0.6, 10.0, 90.0), (3, 2.45, 0.75, degree / 1200, 90.0), (4, 2.55, 0.75, degree / 1200, 270.0), (5, 9.0, 9.0, 30.0, 0.0), (6, 2.5, 0.75, 0.0, 90.0), (7, 0.55, 0.75, degree / 1200, 90.0)]
    got = {r["id"]: (r["over"], r["approaching"], r["eta_minutes"], r["exposure"]) for r in impact.impact(spark.createDataFrame(rows, "id int, lon double, lat double, speed_ms double, bearing_deg double"), areas).collect()}
    assert got[1] == (1, None, None, 0.8) and got[5] == (None, None, None, 0.0) and got[6] == (None, None, None, 0.0)
    assert got[2] == (1, None, None, 0.8)
    assert got[3][:3] == (None, 3, 12.0) and got[3][3] == pytest.approx(1.0 * (1 - 12 / 60) * 0.7)
    assert got[4][:3] == (None, 2, 12.0) and got[4][3] == pytest.approx(0.5 * 0.8 * 0.7)
    assert got[7][:3] == (1, 2, 10.0)  # areas 1 and 2 both hold it at first: the smaller counts; past 1 degree east only 2 does
