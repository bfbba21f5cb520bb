"""The session tape as a stream over sliced, unordered files, against its batch form and plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapewright.streaming import alerts
from tapewright.streaming import tape as T

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
COLUMNS = [c.split()[0] for c in T.READING.split(",")]
SESSIONS = {d: ((0, 1440),) for d in range(4)} | {4: ((0, 720), (840, 1440))}
LIMITS = T.Limits(extreme=2.0, surge=1.4, watch=1.2, block=7_000.0, large=5_500.0, least_turnover=1_000.0)


def rows(n=900, seed=4):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 3)
    out = []
    for i in range(n):
        ts = start + dt.timedelta(seconds=rng.randrange(5 * 86400))
        out.append((i, ts, 1, rng.choice(["a", "a", "b", "c"]), None if rng.random() < 0.02 else round(rng.uniform(1, 90), 2), '{"k": %d}' % rng.randint(0, 99) if rng.random() < 0.97 else None))
    out += [(n, start + dt.timedelta(hours=7), 1, "a", 5.0, '{"k": 3}'), (n + 1, start + dt.timedelta(hours=7), 1, "a", 6.0, '{"k": 4}')]  # at the border of an interval, at one time
    out += [(n + 2, start + dt.timedelta(days=6), 1, "z", 7.0, '{"k": 1}')]  # moves the watermark past all others
    return out


@pytest.fixture(scope="module")
def usual(spark):
    return spark.createDataFrame([("a", 900.0), ("b", 2500.0), ("c", None)], "symbol string, usual_volume double")


def read(spark, path, usual, files, root, late="7 days", build=lambda t: t):
    with T.keyed_state(spark):
        events = T.tape_events(alerts.event_stream(spark, str(path), files), usual)
        return alerts.drain(build(T.tape_stream(events, late, limits=LIMITS, sessions=SESSIONS)), f"{root}/out", f"{root}/state").collect()


def key(r):
    return (r.symbol, r.at)


def same(a, b):
    assert [key(r) for r in a] == [key(r) for r in b]
    for x, y in zip(a, b):
        for c in COLUMNS:
            assert x[c] == y[c] or (x[c] is not None and y[c] is not None and not isinstance(x[c], str) and abs(x[c] - y[c]) < 1e-9 * max(1, abs(y[c]))), (c, x, y)


def test_slices_and_orders_give_the_same_readings(spark, tmp_path, usual):
    """Ten unordered files, read at once, three by three and one by one; and in time order with a short lateness."""
    data = rows()
    # the last row comes in a file of its own, so that every file before it is in time
    last = [r for r in data if r[3] == "z"] + [(10**6, dt.datetime(2024, 1, 30), 1, "z", 1.0, None)]
    rng = random.Random(1)
    parts = [[] for _ in range(9)]
    for r in data:
        if r[3] != "z":
            rng.choice(parts).append(r)
    for i, part in enumerate([*parts, last]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    want = sorted((r for r in T.tape_batch(T.tape_events(df, usual), limits=LIMITS, sessions=SESSIONS).collect()), key=key)
    got = {}
    for files in (None, 3):
        found = read(spark, tmp_path / "in", usual, files, f"file://{tmp_path}/run{files}")
        got[files] = sorted((r for r in found if r.symbol != "z"), key=key)
    assert len(want) > 150 and sum(bool(r.alerts) for r in want) > 10 and {a for r in want for a in r.alerts.split(",") if a} == set(T.ALERTS)
    same(got[None], want)
    same(got[3], want)


def test_batch_readings_against_plain_python(spark, usual):
    data = [r for r in rows(400, 9) if r[4] is not None]
    got = {key(r): r for r in T.tape_batch(T.tape_events(spark.createDataFrame(rows(400, 9), SCHEMA), usual), limits=LIMITS, sessions=SESSIONS).collect()}
    volumes, count = dict(usual.collect()), 0
    for symbol in {r[3] for r in data}:
        own = sorted((r for r in data if r[3] == symbol), key=lambda r: (r[1], r[0]))
        flow, fired, day, prior, last = 0.0, set(), None, None, None
        for at in sorted({(r[1].replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)) for r in own}):
            d = (at - dt.timedelta(seconds=1)).date()
            if d != day:
                flow, fired, day, prior = 0.0, set(), d, last
            so_far = [r for r in own if r[1].date() == d and r[1] < at]
            part = [r for r in so_far if r[1] >= at - dt.timedelta(hours=1)]
            size = lambda rs: sum(float(r[5][6:-1]) if r[5] else 0.0 for r in rs)
            high, low, last = max(r[4] for r in so_far), min(r[4] for r in so_far), so_far[-1][4]
            if high > low and size(part) > 0:
                flow += (2 * last - low - high) / (high - low) * size(part)
            r = got[symbol, at]
            minute = (at - dt.datetime.combine(d, dt.time())).total_seconds() / 60
            done = T.progress_at(d.weekday(), minute, SESSIONS)
            usual_volume = volumes.get(symbol)
            ratio = size(so_far) / (usual_volume * done) if usual_volume and done > 0.05 else None
            assert (r.session, r.volume, r.trades, r.open, r.high, r.low, r.last, r.prior_close) == (d, size(so_far), len(so_far), so_far[0][4], high, low, last, prior)
            assert abs(r.flow - flow) < 1e-6 and abs(r.progress - done) < 1e-9 and (ratio is None) == (r.volume_ratio is None) and (ratio is None or abs(r.volume_ratio - ratio) < 1e-9)
            assert not set(filter(None, r.alerts.split(","))) & fired
            fired |= set(filter(None, r.alerts.split(",")))
            count += 1
    assert count == len(got)


def test_progress_of_sessions(spark):
    assert T.progress_at(0, 570) == 0.01 and T.progress_at(0, 750) == 0.5 and T.progress_at(2, 1000) == 1.0 and T.progress_at(5, 10) == 1.0
    assert T.progress_at(4, 720) == T.progress_at(4, 800) == T.progress_at(4, 855) == 165 / 275 and T.progress_at(4, 910) == (165 + 55) / 275
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * i) for i in range(1, 7 * 48 + 1)]
    got = spark.createDataFrame([(t,) for t in times], "at timestamp").select("at", T.progress(F.col("at")).alias("p")).collect()
    for r in got:
        inside = r["at"] - dt.timedelta(seconds=1)
        assert abs(r["p"] - T.progress_at(inside.weekday(), (r["at"] - dt.datetime.combine(inside.date(), dt.time())).total_seconds() / 60)) < 1e-9


def test_kinds_and_quote_alerts(spark):
    def reading(symbol, volume, turnover, trades, low, high, last, prior):
        return (symbol, None, None, float(volume), float(turnover), trades, last, float(high), float(low), float(last), prior, 1000.0, 0.5, None, (last - low) / (high - low), 0.0, "")

    tape = spark.createDataFrame([
        reading("accum", 2000, 2_000_000, 5, 10, 20, 19.0, 15.0), reading("dist", 2000, 3_000_000, 5, 10, 20, 11.0, 15.0), reading("press", 2000, 200_000, 5, 10, 20, 11.0, 15.0),
        reading("block", 100, 2_000_000, 3, 10, 20, 15.0, 15.0), reading("surge", 2000, 200_000, 5, 10, 20, 15.0, 15.0), reading("quiet", 100, 200_000, 5, 10, 20, 19.0, 18.9),
        reading("odd", 1000, 200_000, 5, 10, 20, 15.0, None), reading("small", 5000, 90_000, 5, 10, 20, 19.0, 15.0), reading("few", 5000, 900_000, 2, 10, 20, 19.0, 15.0), reading("calm", 100, 200_000, 5, 10, 20, 15.0, 15.0),
    ], T.READING)
    got = {r.symbol: (r.kind, r.score) for r in T.tape_kinds(tape).collect()}
    assert got == {
        "accum": ("ACCUMULATION", 7.0), "dist": ("DISTRIBUTION", -8.5), "press": ("SELLING PRESSURE", -5.5), "block": ("BLOCK TRADES", 3.0), "surge": ("VOLUME SURGE", 3.0),
        "quiet": ("QUIET STRENGTH", 1.5), "odd": ("UNUSUAL ACTIVITY", 1.5),
    }
    daily = spark.createDataFrame([("accum", 0.2, True), ("dist", -0.2, False), ("quiet", 0.2, None), ("calm", -0.2, True), ("odd", None, None)], "symbol string, cmf double, obv_up boolean")
    got = {r.symbol: r.found for r in T.quote_alerts(tape, daily).collect()}
    assert got == {"accum": "VOLUME_SURGE,ACCUMULATION", "dist": "VOLUME_SURGE,DISTRIBUTION", "odd": "VOLUME_SURGE"}
