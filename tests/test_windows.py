"""Window operators against values by hand."""

from envspark.operators import windows


def test_severity_falls_only_past_the_slack(spark):
    tracks = {
        1: [(50.5, 10.0), (49.4, 10.0), (47.0, 10.0), (42.0, 10.0)],  # held within 2 dB, then one frame a fall
        2: [(x, 10.0) for x in (50.3, 49.6, 50.4, 49.5, 50.1, 49.7, 50.2, 49.4)],
        3: [(40.0, 50.0), (40.0, 42.5), (40.0, 42.0)],
        4: [(56.0, 60.0), (20.0, 1.0), (50.5, 10.0)],
    }
    rows = [(t, f, *c) for t, cells in tracks.items() for f, c in enumerate(cells)] + [(2, 20, 49.4, 10.0)]
    cells = spark.createDataFrame(rows, "track int, frame int, most double, area_km2 double")
    got = {(r["track"], r["frame"]): r["severities"] for r in windows.severity_hysteresis(cells).collect()}
    assert got == {(1, 0): [2, 2, 1, 0], (2, 0): [2] * 8, (2, 20): [1], (3, 0): [1, 1, 0], (4, 0): [3, 0, 2]}
