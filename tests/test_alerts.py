"""Instants of alerts under a limit, against a plain reading of the rule."""

import random
from datetime import datetime, timedelta

from envspark.operators import aggregates, features
from pyspark.sql import functions as F

NOW = datetime(2024, 1, 15)


def plain(windows, limit):
    """windows: (start, end, severity) in hours from now, open ends None."""
    low, high = -(10**9), 10**9
    bounds = sorted({0} | {t for s, e, _ in windows for t in (s, e) if t is not None and t <= 168})
    if len(bounds) <= limit:
        return bounds
    near = lambda t: (abs(t), t)
    open_ = []
    for s, e, severity in windows:
        anchor = s if s is not None else e
        lo, hi = low if s is None else s, high if e is None else e
        if anchor is not None and anchor <= 168 and lo <= hi and not lo <= 0 <= hi:
            open_.append((anchor, lo, hi, hi < 0, severity or 0))

    def stab(some, kept):
        chosen = set()
        for anchor, lo, hi, *_ in sorted(some, key=lambda u: -u[0]):
            if not any(lo <= t <= hi for t in kept | chosen):
                chosen.add(anchor)
        return chosen

    kept = {0}
    if len(stab(open_, kept)) + 1 <= limit:
        kept |= stab(open_, kept)
    else:
        for tier in sorted({(u[3], -u[4]) for u in open_}):
            for t in sorted(stab([u for u in open_ if (u[3], -u[4]) == tier], kept), key=near):
                if len(kept) < limit:
                    kept.add(t)
    for t in sorted(bounds, key=near):
        if len(kept) < limit:
            kept.add(t)
    return sorted(kept)


def test_alert_times_equal_the_plain_rule(spark):
    for seed in range(6):
        rng = random.Random(seed)
        windows = []
        for _ in range(120):
            s = rng.randint(-300, 200)
            windows.append((rng.choice([s, s, s, None]), rng.choice([s + rng.randint(-1, 40), s + 3, None]), rng.choice([None, 1, 2, 3, 4])))
        at = lambda h: None if h is None else NOW + timedelta(hours=h)
        df = spark.createDataFrame([(at(s), at(e), v) for s, e, v in windows], "start timestamp_ntz, end timestamp_ntz, severity int")
        for limit in (1000, 60, 12, 3):
            got = sorted((r["time"] - NOW).total_seconds() / 3600 for r in aggregates.alert_times(df, F.lit(NOW).cast("timestamp_ntz"), limit).collect())
            assert got == plain(windows, limit), (seed, limit)


def test_without_alerts_now_is_left(spark):
    df = spark.createDataFrame([], "start timestamp_ntz, end timestamp_ntz, severity int")
    assert [r["time"] for r in aggregates.alert_times(df, F.lit(NOW).cast("timestamp_ntz")).collect()] == [NOW]


def test_ids_and_unknown_parameters(spark):
    row = spark.createDataFrame([("Sää", "A:1", 2, 0)], "s string, i string, info int, area int").select(features.feature_id(*map(F.col, ("s", "i", "info", "area"))).alias("id")).first()
    assert row["id"] == "cap:5:SääA:1.2.0"
    have = spark.createDataFrame([(0, "Click")], "place int, parameter string")
    ask = lambda n: features.select_parameters(have, spark.createDataFrame([(0, n)], "position int, name string")).collect()
    assert [tuple(r) for r in ask("click")] == [(0, "Click")]
    try:
        ask("none")
    except Exception as error:  # noqa: BLE001
        assert "no such parameter: none" in str(error)
    else:
        raise AssertionError("an unknown parameter passed")
