"""Streams with state tables: any order of micro-batches gives the batch's answer, and plain loops give the same."""

import random
from datetime import datetime, timedelta

from envspark.operators import ingest
from envspark.streaming import states

T0 = datetime(2024, 1, 1)
MESSAGE = "data_id string, pubtime timestamp, deletion boolean, sender string, identifier string, sent timestamp, msg_type string, expires timestamp, severity int, references array<struct<sender:string,identifier:string,sent:timestamp>>"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def scene(seed, n=90):
    rng, out, sent = random.Random(seed), [], []
    for i in range(n):
        key = (f"s{rng.randrange(2)}", f"i{rng.randrange(9)}", rng.randrange(40))
        if rng.random() < 0.15:
            out.append((f"d{rng.randrange(14)}", rng.randrange(60), True, None, None, None, None, None, None, []))
        else:
            refs = rng.sample(sent, min(len(sent), rng.randrange(3)))
            out.append((f"d{rng.randrange(14)}", rng.randrange(60), False, *key, rng.choice(["Alert", "Alert", " update", "Cancel", "Ack"]), rng.choice([None, 50, 70]), rng.randrange(5), refs))
            sent.append(key)
    return out


def plain(messages):
    content = [m for m in messages if not m[2]]
    gone, wd, win = {}, {}, {}
    for d, p, deletion, *_ in messages:
        if deletion:
            gone[d] = max(gone.get(d, -1), p)
    for d, p, _, s, i, t, kind, _, severity, refs in content:
        if kind.strip().lower() in ("update", "cancel"):
            for r in refs:
                wd[r] = max(wd.get(r, -1), p)
        if p <= gone.get(d, -1):
            wd[s, i, t] = max(wd.get((s, i, t), -1), gone[d])
        if kind.strip().lower() in ("alert", "update"):
            win[s, i] = max(win.get((s, i), (-1, -1, "")), (p, t, d))
    return sorted((s, i, t, d, p) for (s, i), (p, t, d) in win.items() if p > wd.get((s, i, t), -1) and p > gone.get(d, -1))


def rows_of(spark, messages):
    return spark.createDataFrame([(d, at(p), x, s, i, at(t), k, at(e), v, [(a, b, at(c)) for a, b, c in refs]) for d, p, x, s, i, t, k, e, v, refs in messages], MESSAGE).coalesce(1)


def hours(t):
    return round((t - T0).total_seconds() / 3600)


def test_alerts_in_any_order(spark, tmp_path):
    for seed in (1, 2):
        messages = scene(seed)
        want = plain(messages)
        assert 3 < len(want) < 18
        random.Random(seed).shuffle(messages)
        path = str(tmp_path / f"state{seed}")
        for k in range(4):
            rows_of(spark, messages[k::4]).write.mode("append").parquet(str(tmp_path / f"in{seed}"))
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{seed}"))
        states.folded(stream, path, states.alert_fold(10**8)).option("checkpointLocation", str(tmp_path / f"o{seed}")).trigger(availableNow=True).start().awaitTermination(200)
        versions = states.Versions(spark, path)
        assert versions.numbers() == [2, 3]  # older ones are gone, the last but one stays for a batch that runs again
        for state in (versions.latest(), states.alert_fold(10**8)(None, rows_of(spark, messages))):
            got = sorted((r["sender"], r["identifier"], hours(r["sent"]), r["data_id"], hours(r["pubtime"])) for r in states.held_alerts(state).collect())
            assert got == want


def test_late_copies_stay_out_and_state_shrinks(spark):
    fold = states.alert_fold(10 * 3600)
    first = ("d1", 0, False, "s", "i", 0, "Alert", 5, 3, [])
    state = fold(None, rows_of(spark, [first, ("d2", 0, False, "s", "j", 0, "Alert", None, 3, [])]))
    assert states.held_alerts(state).count() == 2
    state = fold(state, rows_of(spark, [("d1", 1, True, None, None, None, None, None, None, [])]))
    assert [r["identifier"] for r in states.held_alerts(state).collect()] == ["j"]
    state = fold(state, rows_of(spark, [first, ("d9", 1, False, "s", "i", 0, "Alert", 5, 3, [])]))  # a late copy, and one under another data_id
    assert [r["identifier"] for r in states.held_alerts(state).collect()] == ["j"]
    again = fold(state, rows_of(spark, [("d1", 2, False, "s", "i", 2, "Alert", 5, 3, [])]))
    assert sorted(r["identifier"] for r in states.held_alerts(again).collect()) == ["i", "j"]
    after = fold(again, rows_of(spark, [("d3", 14, False, "s", "k", 14, "Alert", 20, 1, [])]))
    assert sorted(r["identifier"] for r in after.filter("kind = 'alert'").collect()) == ["i", "k"]  # j never expires: grace after its publication
    last = fold(after, rows_of(spark, [("d3", 40, False, "s", "l", 40, "Alert", 50, 1, [])]))
    assert last.count() == 2 and [r["identifier"] for r in states.held_alerts(last).collect()] == ["l"]  # k is gone, grace after it expired


def news(rows):
    ids, newest, out = set(), {}, []
    for i, d, p, r in sorted(rows, key=lambda x: (x[3], x[0])):
        if i not in ids and p > newest.get(d, -1):
            ids.add(i)
            newest[d] = p
            out.append((i, d, p, r))
    return sorted(out)


def test_ids_are_remembered_over_all_data_ids(spark):
    rng = random.Random(8)
    rows = [(f"m{rng.randrange(60)}", f"d{rng.randrange(8)}", rng.randrange(50), r) for r in range(150)]
    df = lambda x: spark.createDataFrame([(i, d, at(p), at(r)) for i, d, p, r in x], "id string, data_id string, pubtime timestamp, received timestamp")
    flat = lambda f: sorted((r["id"], r["data_id"], hours(r["pubtime"]), hours(r["received"])) for r in f.collect())
    assert flat(ingest.only_news(df(rows), "received")) == news(rows)
    fold, state, got = states.dedup_fold(10**8), None, []
    for k in range(0, 150, 50):
        state = fold(state, df(rows[k : k + 50]))
        got += flat(state.filter("fresh").drop("fresh"))
    assert sorted(got) == news(rows)
    short = states.dedup_fold(3600 * 10)
    state = short(short(None, df([("a", "d", 5, 0)])), df([("a", "d", 5, 4)]))
    assert state.count() == 1 and not state.first()["fresh"]
    assert sorted(r["fresh"] for r in short(state, df([("a", "d", 5, 30)])).collect()) == [True]  # forgotten after the window


def test_rolling_sums_equal_sums_afresh_at_every_batch(spark):
    rng = random.Random(4)
    fold, state, known = states.rolling_fold(5 * 3600), None, {}
    for k in range(10):
        batch = [(c, k + rng.choice([0, 0, 0, -1, -3]), rng.choice([0.1, 0.7, 1e9, -3.3])) for c in rng.sample(range(6), 3)] if k < 8 else [(9, k + 8 * (k - 7), 2.0)]
        batch = list({(c, t): (c, t, v) for c, t, v in batch if t >= 0}.values())
        state = fold(state, spark.createDataFrame([(c, at(t), v) for c, t, v in batch], "cell int, time timestamp, value double"))
        known |= {(c, t): v for c, t, v in batch}
        end = max(t for _, t in known)
        known = {x: v for x, v in known.items() if x[1] > end - 5}
        got = {r["cell"]: (r["value"], r["n"]) for r in state.filter("kind = 'sum'").collect()}
        want = {c: (sum(v for (d, _), v in known.items() if d == c), sum(d == c for d, _ in known)) for c in {c for c, _ in known}}
        assert {c: n for c, (_, n) in got.items() if n} == {c: n for c, (_, n) in want.items()}
        assert all(abs(got[c][0] - v) <= 1e-6 * max(1, abs(v)) for c, (v, _) in want.items())
        assert all(v == 0.0 for v, n in got.values() if n == 0)
        state = spark.createDataFrame(state.collect(), state.schema)
