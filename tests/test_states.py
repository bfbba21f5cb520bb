"""Prefix folds, signals with memory, masked indicators, triangles and the replay against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions import scans
from tapewright.operators import decision_states as D
from tapewright.operators import detectors, masked, replay, volume_lines
from tapewright.sources.panels import daily_bars

SF = "/root/testdata/sf0.001"
BARS = "symbol string, bar_ix int, trade_date date, open double, high double, low double, close double, volume double"


def series(n, seed, symbol="a", null=0.0):
    rng = random.Random(seed)
    return [(symbol, i + 1, None if rng.random() < null else rng.uniform(-3, 9)) for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_ewma_skips_nulls_like_pandas(spark, block):
    rows = series(150, 1, "a", 0.3) + series(1, 2, "b") + series(70, 3, "c", 1.0) + series(64, 4, None) + series(65, 5, "d", 0.05)
    df = spark.createDataFrame(rows, "symbol string, bar_ix int, x double").withColumn("row", F.lit(1)).repartition(3)
    got = scans.ewma(df, {"y": (F.col("x"), 1 / 14), "z": (F.col("x"), 0.5)}, least=5, block=block).toPandas()
    assert list(got.columns) == ["symbol", "bar_ix", "x", "row", "y", "z"] and len(got) == len(rows)
    for _, part in got.groupby("symbol", dropna=False):
        part = part.sort_values("bar_ix")
        for name, alpha in (("y", 1 / 14), ("z", 0.5)):
            want = part.x.astype(float).ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=5).mean()
            # pandas is null before enough values; both carry the mean over later nulls
            np.testing.assert_allclose(part[name].astype(float), want, rtol=1e-9)


def test_automaton_folds_maps(spark):
    rng = random.Random(6)
    rows = [(k, i, [rng.randrange(5) for _ in range(5)]) for k, n in (("a", 200), ("b", 1), ("c", 65)) for i in range(n)]
    got = scans.automaton(spark.createDataFrame(rows, "symbol string, bar_ix int, to array<int>"), F.col("to"), 2, "state", block=8).collect()
    state = {}
    for k, i, to in rows:
        state[k] = to[state.get(k, 2)]
        assert next(r.state for r in got if r.symbol == k and r.bar_ix == i) == state[k]
    assert scans.automaton(spark.createDataFrame([], "symbol string, bar_ix int, to array<int>"), F.col("to"), 2, "state").count() == 0


INPUTS = (
    "symbol string, bar_ix int, price double, score double, eligible boolean, breakdown boolean, confirming boolean, extension double, momentum double,"
    " index_above double, earnings_in int, concentrated boolean, poor_reward boolean, confidence double, flow double, strength double"
)


def plain_signal(last, r, rules):
    """The rules one after the other on a known last signal."""
    if not r["price"] or r["price"] <= 0:
        return "No data"
    if r["breakdown"]:
        return "Exit" if last in ("Buy", "Strong Buy", "Hold") else "Avoid"
    if not r["eligible"]:
        return "Avoid"
    names = ["Avoid", "Hold", "Watch", "Buy", "Strong Buy"]
    limits = [None, rules.hold, rules.watch, rules.buy, rules.strong_buy]
    score = r["score"] if r["score"] is not None else -1e9
    k = max([0] + [i for i in range(1, 5) if score >= limits[i]])
    if k == 4 and not r["confirming"]:
        k = 3
    if rules.band > 0 and last in names:
        p = names.index(last)
        if p == k + 1 and score >= limits[p]:
            k = p
        elif p == k - 1 and score < limits[k] + rules.band:
            k = p
    if k == 4 and last != "Strong Buy":
        k = 3
    if rules.chase_guard:
        above = r["index_above"]
        wide = 1 + (rules.widen - 1) * min(1, above / rules.widen_full) if above is not None and above > 0 else 1
        if (r["extension"] is not None and r["extension"] > rules.most_extended * wide) or (r["momentum"] is not None and r["momentum"] > rules.most_momentum * wide):
            k = k - 1 if k >= 3 else k
    shut = (r["earnings_in"] is not None and 0 <= r["earnings_in"] <= rules.earnings_days) or r["concentrated"] or r["poor_reward"]
    shut = shut or (r["confidence"] is not None and r["confidence"] < rules.least_confidence) or (r["flow"] is not None and r["flow"] <= rules.least_flow)
    shut = shut or (r["strength"] is not None and r["strength"] < rules.least_strength) or (rules.regime_gate and r["index_above"] is not None and r["index_above"] <= 0)
    return names[2] if shut and k >= 3 else names[k]


@pytest.mark.parametrize("start, rules", [("none", D.Rules()), ("Strong Buy", D.Rules(band=2.5, chase_guard=True, regime_gate=True, widen=1.6))])
def test_signals_against_plain_rules(spark, start, rules):
    rng = random.Random(8)
    maybe = lambda x, p=0.06: None if rng.random() < p else x
    rows = []
    for s, n in (("a", 600), ("b", 90), ("c", 1)):
        score = 92.0
        for i in range(n):
            score = min(95.0, max(40.0, score + rng.uniform(-6, 6)))
            if i > 4 and rng.random() < 0.15:
                score = rng.choice([50.0, 60.0, 62.5, 70.0, 72.5, 80.0, 82.5, 90.0])
            rows.append((
                s, i, maybe(rng.choice([10.0] * 30 + [0.0])), maybe(score, 0.03), maybe(rng.random() < 0.97), maybe(rng.random() < 0.03), maybe(rng.random() < 0.85), maybe(rng.uniform(-5, 13)), maybe(rng.uniform(-5, 19)),
                maybe(rng.uniform(-1, 12)), maybe(rng.randint(-1, 150)), maybe(rng.random() < 0.02), maybe(rng.random() < 0.02), maybe(rng.uniform(43, 99)), maybe(rng.uniform(-0.01, 0.5)), maybe(rng.uniform(-21, 40)),
            ))
    df = spark.createDataFrame(rows, INPUTS).repartition(4)
    got = {(r.symbol, r.bar_ix): (r.signal, r.last_signal) for r in D.signal_states(df, rules, start, block=16).collect()}
    names, last, seen = [f.name for f in df.schema], {}, set()
    for row in rows:
        r = dict(zip(names, row))
        before = last.get(r["symbol"], start)
        last[r["symbol"]] = want = plain_signal(before, r, rules)
        seen.add(want)
        assert got[r["symbol"], r["bar_ix"]] == (want, before if r["bar_ix"] else None), (r, before)
    assert seen == set(D.SIGNALS[:7]) - ({"Strong Buy"} if start == "none" else set())


def flat_bars(n=80, seed=3):
    rng = random.Random(seed)
    day, rows = pd.Timestamp("2024-01-01"), []
    close = 100.0
    for i in range(n):
        new = close * (1 + rng.uniform(-0.03, 0.031))
        locked = rng.random() < 0.2
        high, low = (new, new) if locked else (max(close, new) + 0.5, min(close, new) - 0.5)
        rows.append(("a", i + 1, (day + pd.Timedelta(days=i)).date(), close, high, low, new, 2.0 if locked else rng.uniform(50, 150)))
        close = new
    return rows


def test_masked_indicators_like_pandas(spark):
    rows = flat_bars()
    df = spark.createDataFrame(rows, BARS)
    p = pd.DataFrame(rows, columns=[f.name for f in df.schema])
    p["locked"] = (p.high == p.low) & (p.volume < 0.1 * p.volume[p.volume > 0].median())
    before = p.close.shift(1)
    tr = pd.concat([p.high - p.low, (p.high - before).abs(), (p.low - before).abs()], axis=1).max(axis=1).where(~p.locked)
    got = masked.locked_atr(df).toPandas().sort_values("bar_ix")
    assert got.is_locked.tolist() == p.locked.tolist() and p.locked.sum() > 5
    np.testing.assert_allclose(got.atr_unlocked.astype(float), tr.ewm(alpha=1 / 14, adjust=False, ignore_na=True, min_periods=14).mean(), rtol=1e-9)
    np.testing.assert_allclose(got.avg_volume_unlocked.astype(float), p.volume.where(~p.locked).rolling(20, min_periods=10).mean(), rtol=1e-9)
    diff = p.close.diff()
    up, down = diff.clip(lower=0), -diff.clip(upper=0)
    gain, loss = (x.ewm(alpha=1 / 14, adjust=False).mean() for x in (up, down))
    rsi = masked.rsi_variants(df).toPandas().sort_values("bar_ix")
    np.testing.assert_allclose(rsi.rsi_50.astype(float), (100 - 100 / (1 + gain / loss.replace(0, np.nan))).fillna(50), rtol=1e-9)
    gain, loss = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (up, down))
    np.testing.assert_allclose(rsi.rsi_100.astype(float), (100 - 100 / (1 + gain / loss.replace(0, np.nan))).where(loss != 0, 100), rtol=1e-9)
    rise = spark.createDataFrame([("r", i, None, 1.0, 1.0, 1.0, float(i), 1.0) for i in range(1, 20)], BARS)
    last = masked.rsi_variants(rise).filter("bar_ix = 19").first()
    assert last.rsi_50 == 50 and last.rsi_100 == 100


def test_triangle_rails(spark):
    """Falling highs and rising lows squeeze; parallel rails do not."""
    def bars(symbol, low_step):
        rows, day = [], pd.Timestamp("2024-01-01")
        for i in range(70):
            phase = i % 10
            top, bottom = 120 - 0.05 * i, 100 + low_step * i
            mid = bottom + (top - bottom) * (phase / 5 if phase <= 5 else (10 - phase) / 5)
            rows.append((symbol, i + 1, (day + pd.Timedelta(days=i)).date(), mid, mid + 0.1, mid - 0.1, mid, 1.0))
        return rows

    got = masked.regression_triangles(spark.createDataFrame(bars("up", 0.15) + bars("flat", 0.0), BARS)).collect()
    assert got and {r.symbol for r in got} == {"up"}
    for r in got:
        assert r.high_r2 > 0.99 and r.low_r2 > 0.99 and r.high_drift < 0 and r.low_drift > 2 and min(r.highs, r.lows) >= 2
        assert r.stop == pytest.approx(1.01 * (r.entry + 0.1)) and r.target == pytest.approx(r.entry - 3 * (r.stop - r.entry))


def test_replay_does_not_look_ahead(spark):
    """A signal as of a bar is the same where the history ends there."""
    bars = daily_bars(spark, SF).cache()
    whole = replay.replayed(bars).select("symbol", "bar_ix", "signal_type", "score", "new_signal").filter("bar_ix <= 400").toPandas()
    short = replay.replayed(bars.filter("bar_ix <= 400")).select("symbol", "bar_ix", "signal_type", "score", "new_signal").toPandas()
    key = ["symbol", "bar_ix"]
    pd.testing.assert_frame_equal(whole.sort_values(key, ignore_index=True), short.sort_values(key, ignore_index=True))


def test_circuit_is_the_fullest_bin(spark):
    closes = [100.0]
    for r in [0.01, 0.0752, 0.0758, 0.06, 0.0751, 0.0601, 0.2, 0.1099, -0.1]:
        closes.append(closes[-1] * (1 + r))
    rows = [("a", i + 1, None, c, c, c, c, 1.0) for i, c in enumerate(closes)]
    assert replay.circuit_limit(spark.createDataFrame(rows, BARS)).first().circuit == 0.075
    assert replay.circuit_limit(spark.createDataFrame(rows[:2], BARS)).first().circuit == 0.1


def test_three_line_strike_after_a_rise(spark):
    day = pd.Timestamp("2024-01-01")

    def bars(symbol, start, last_volume=500.0, last_close=None):
        rows = [(start + (100 - start) * i / 24, start + (100 - start) * (i + 1) / 24) for i in range(24)]
        rows += [(100.0, 98.0), (98.0, 96.0), (96.0, 94.0), (93.5, last_close or 100.5)]
        return [(symbol, i + 1, (day + pd.Timedelta(days=i)).date(), o, max(o, c) + 0.2, min(o, c) - 0.2, c, last_volume if i == 27 else 100.0) for i, (o, c) in enumerate(rows)]

    df = spark.createDataFrame(bars("valid", 80.0) + bars("thin", 80.0, 100.0) + bars("flat", 99.0) + bars("short", 80.0, 500.0, 99.0), BARS)
    got = {r.symbol: r for r in detectors.three_line_strikes(df).collect()}
    assert set(got) == {"valid", "thin"} and got["valid"].is_valid and not got["thin"].is_valid
    r = got["valid"]
    assert r.entry == 100.5 and r.target1 == pytest.approx(100.5 + 100.7 - 93.3) and r.target2 == pytest.approx(100.5 + 2 * (100.7 - 93.3)) and r.stop < 93.3 - 0.005 * 100.5 + 1e-9


def test_volume_lines_like_pandas(spark):
    rows = flat_bars(120, 5)
    df = spark.createDataFrame(rows, BARS)
    p = pd.DataFrame(rows, columns=[f.name for f in df.schema])
    got = volume_lines.volume_lines(df).toPandas().sort_values("bar_ix")
    pvt = (p.close.pct_change() * 100 * p.volume).cumsum()
    mean = lambda x, n: x.ewm(span=n, adjust=False).mean()
    kvo = mean(p.volume, 34) - mean(p.volume, 55)
    for name, want in (("pvt", pvt), ("pvt_mean", mean(pvt, 20)), ("force", mean(p.close.diff() * p.volume, 13)), ("klinger", kvo), ("klinger_mean", mean(kvo, 13))):
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-8, atol=1e-8)
