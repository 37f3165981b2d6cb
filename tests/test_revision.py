"""Fields are computed again for changed times only."""

import datetime
import os

import pytest

from envspark.operators import revision

VALUES = "time int, station_id int, value double"


def files(path):
    out = {}
    for folder, _, names in os.walk(f"{path}/fields"):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(os.path.basename(folder), set()).add((n, os.stat(f"{folder}/{n}").st_mtime_ns))
    return out


def test_only_changed_times_are_written(spark, tmp_path):
    path = str(tmp_path / "grid")
    targets = spark.createDataFrame([(1, 20.0, 60.0), (2, 20.5, 60.0), (3, 40.0, 10.0)], "id int, lon double, lat double")
    stations = spark.createDataFrame([(7, 20.0, 60.0), (8, 20.4, 60.0)], "station_id int, lon double, lat double")
    run = lambda rows, at=stations: sorted(r["time"] for r in revision.revise(spark, path, targets, at, spark.createDataFrame(rows, VALUES), 50_000).collect())
    now = lambda: {(r["time"], r["id"]): (r["estimate"], r["neighbours"]) for r in revision.current(spark, path).collect()}
    rows = [(t, s, float(t + s)) for t in range(1, 5) for s in (7, 8)] + [(2, 7, None)]
    with pytest.raises(ValueError):
        revision.current(spark, path)
    assert run(rows) == [1, 2, 3, 4]
    assert set(now()) == {(t, i) for t in range(1, 5) for i in (1, 2)} and now()[1, 1] == (8.0, 2)  # a station on the spot
    first = files(path)
    assert run(rows[::-1]) == [] and files(path) == first
    rows = [(t, s, v + 10 * (t == 2)) for t, s, v in rows if v is not None and t != 4] + [(5, 8, 1.0)]
    assert run(rows) == [2, 5]
    second = files(path)
    assert second["time=1"] == first["time=1"] and second["time=3"] == first["time=3"] and second["time=2"] != first["time=2"]
    assert {t for t, _ in now()} == {1, 2, 3, 5} and now()[2, 1] == (19.0, 2) and now()[5, 2] == (1.0, 1)
    # two stations swap their values: the sum of values stays, the field doesn't
    assert run([(t, 15 - s if t == 3 else s, v) for t, s, v in rows]) == [3] and now()[3, 1] == (11.0, 2)
    # a station that moves changes every time it has a value at; one out of reach leaves no field behind
    moved = spark.createDataFrame([(7, 20.0, 60.0), (8, 0.0, 0.0)], "station_id int, lon double, lat double")
    assert run([(t, 15 - s if t == 3 else s, v) for t, s, v in rows], moved) == [1, 2, 3, 5]
    assert {t for t, _ in now()} == {1, 2, 3} and now()[1, 2] == (8.0, 1)


def test_a_run_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "grid")
    targets = spark.createDataFrame([(1, 20.0, 60.0)], "id int, lon double, lat double")
    stations = spark.createDataFrame([(7, 20.0, 60.0)], "station_id int, lon double, lat double")
    values = lambda v: spark.createDataFrame([(1, 7, v)], VALUES)
    revision.revise(spark, path, targets, stations, values(1.0), 50_000)
    with monkeypatch.context() as m:
        m.setattr(revision.Versions, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            revision.revise(spark, path, targets, stations, values(2.0), 50_000)
    assert revision.revise(spark, path, targets, stations, values(2.0), 50_000).count() == 1
    assert revision.current(spark, path).first()["estimate"] == 2.0


def test_analysis_times(spark):
    at = lambda *texts: spark.createDataFrame([(datetime.datetime.fromisoformat(t) if t else None,) for t in texts], "time timestamp_ntz")
    take = lambda *a: sorted(r["time"].strftime("%H:%M:%S") for r in revision.analysis_times(*a).collect())
    seen = at("2024-01-01 00:10:00", None, "2024-01-01 00:35:30", "2024-01-01 00:10:00")
    assert take(seen, 600) == ["00:10:00", "00:20:00", "00:30:00"] and take(seen, 600, 2) == ["00:20:00", "00:30:00"]
    assert take(seen) == ["00:10:00", "00:35:30"] and take(seen, None, 1) == ["00:35:30"]
    assert take(at("2024-01-01 00:11:00", "2024-01-01 00:19:00"), 600) == [] and take(at(None), 600) == [] and take(at(None)) == []
