"""Golden panels and properties of the library's helpers."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions import scalars
from tapewright.functions.windows import asof_backward, run_length
from tapewright.operators import candles as candle_rules
from tapewright.operators import evidence, indicators, kernels, pivots, scoring, signals, statistics
from tapewright.sources import readers

BARS = "symbol string, trade_date date, open double, high double, low double, close double, volume double, bar_ix int"


def walk(n=300, seed=1, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = np.concatenate([[100.0], close[:-1]])
    high, low = np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99
    days = pd.bdate_range("2020-01-01", periods=n).date
    return pd.DataFrame({"symbol": symbol, "trade_date": days, "open": open_, "high": high, "low": low, "close": close, "volume": 1e6 + rng.integers(0, 1e5, n).astype(float), "bar_ix": np.arange(1, n + 1, dtype="int32")})


def candles(rows):
    return pd.DataFrame([("A", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), *r, 1.0, i + 1) for i, r in enumerate(rows)], columns=["symbol", "trade_date", "open", "high", "low", "close", "volume", "bar_ix"])


def test_indicators_equal_pandas(spark):
    p = walk()
    got = indicators.trend(spark.createDataFrame(p, BARS)).orderBy("bar_ix").toPandas()
    assert np.allclose(got["sma20"], p["close"].rolling(20).mean(), equal_nan=True)
    assert np.allclose(got["bb_up"], p["close"].rolling(20).mean() + 2 * p["close"].rolling(20).std(), equal_nan=True)
    risk = indicators.volatility(spark.createDataFrame(p, BARS)).orderBy("bar_ix").toPandas()
    assert np.allclose(risk["close_med90"], p["close"].rolling(90).median(), equal_nan=True)


def test_kernels_equal_pandas_ewm(spark):
    p = walk()
    got = kernels.recursive(spark.createDataFrame(p, BARS)).orderBy("bar_ix").toPandas()
    assert np.allclose(got["ema26"], p["close"].ewm(span=26, adjust=False).mean())
    macd = p["close"].ewm(span=12, adjust=False).mean() - p["close"].ewm(span=26, adjust=False).mean()
    assert np.allclose(got["macd_signal"], macd.ewm(span=9, adjust=False).mean())


@pytest.mark.parametrize("build", [lambda b: indicators.trend(b), lambda b: indicators.volume(b), lambda b: kernels.recursive(b), lambda b: kernels.supertrend(b), lambda b: candle_rules.candle_frame(b), lambda b: signals.range_frame(b)])
def test_the_future_changes_nothing(spark, build):
    """Cutting the future off leaves the past as it was."""
    p = walk(200)
    full = build(spark.createDataFrame(p, BARS)).filter("bar_ix <= 150").orderBy("bar_ix").toPandas()
    cut = build(spark.createDataFrame(p.head(150), BARS)).orderBy("bar_ix").toPandas()
    pd.testing.assert_frame_equal(full, cut)


def test_pivots_are_known_only_when_confirmed(spark):
    p = walk(250)
    full = pivots.pivots(spark.createDataFrame(p, BARS)).filter("confirmed_ix <= 200").toPandas()
    assert len(full) > 5 and (full["confirmed_ix"] - full["bar_ix"] == 3).all()


def test_golden_candles(spark):
    rows = [(10, 11, 9, 10)] * 12 + [(10, 10.2, 8.9, 9), (8.8, 10.4, 8.7, 10.3)]
    got = signals.long_form(candle_rules.candle_frame(spark.createDataFrame(candles([tuple(map(float, r)) for r in rows]), BARS)), candle_rules.CANDLES, ["bar_ix"]).filter("bar_ix = 14").collect()
    assert "Bullish engulfing" in {r.signal for r in got}


def test_barriers_against_a_loop(spark):
    p = walk(120, seed=3)
    got = {r.bar_ix: r.label for r in statistics.triple_barrier(spark.createDataFrame(p, BARS)).collect()}
    for i in range(len(p)):
        want = None
        if i + 20 < len(p):
            want = 0
            for j in range(i + 1, i + 21):
                if p.low[j] <= p.close[i] * 0.98:
                    want = -1
                    break
                if p.high[j] >= p.close[i] * 1.03:
                    want = 1
                    break
        assert got[i + 1] == want


def test_cooldown_is_greedy(spark):
    rng = random.Random(2)
    ix = sorted(rng.sample(range(1000), 150))
    got = sorted(r.bar_ix for r in pivots.cooldown(spark.createDataFrame([("A", i) for i in ix], "symbol string, bar_ix int"), 20).collect())
    want, last = [], None
    for i in ix:
        if last is None or i - last >= 20:
            want.append(i)
            last = i
    assert got == want


def test_asof_and_interval_joins(spark):
    rng = random.Random(3)
    left = [("A", rng.randint(0, 100), i) for i in range(60)]
    right = [("A", t, float(t)) for t in rng.sample(range(100), 20)]
    l, r = spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, at int, v double")
    for strict in (False, True):
        got = {x.id: x.v for x in asof_backward(l, r, "t", "at", ["k"], ["v"], strict).collect()}
        for _, t, i in left:
            fit = [v for _, a, v in right if (a < t if strict else a <= t)]
            assert got[i] == (max(fit) if fit else None)
    base = pd.Timestamp("2020-01-01").date()
    day = lambda n: base + pd.Timedelta(days=n)
    ev = [(i, "A", day(rng.randint(0, 400))) for i in range(80)]
    sp = [(i, "A", day(s := rng.randint(0, 300)), None if i % 4 == 0 else day(s + rng.randint(0, 200))) for i in range(12)]
    got = sorted((x.id, x.s) for x in evidence.interval_join(spark.createDataFrame(ev, "id int, k string, d date"), spark.createDataFrame(sp, "s int, k string, a date, b date"), "d", "a", "b", ["k"]).collect())
    assert got == sorted((i, s) for i, _, d in ev for s, _, a, b in sp if a <= d and (b is None or d <= b))


def test_run_length(spark):
    flags = [1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([("A", i, bool(f)) for i, f in enumerate(flags)], "symbol string, bar_ix int, f boolean")
    assert [r.n for r in run_length(df, F.col("f"), "n").orderBy("bar_ix").collect()] == [1, 2, 0, 1, 2, 3, 0, 0, 1]


def test_scalars(spark):
    df = spark.createDataFrame([("1,234.5",), ("(1,234)",), (" 7 ",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.parse_number(F.col("s"))).collect()] == [1234.5, -1234.0, 7.0, None, None]
    low, high = spark.range(1).select(*scalars.wilson(F.lit(8), F.lit(10))).first()
    assert abs(low - 0.4902) < 1e-3 and abs(high - 0.9433) < 1e-3


def test_csv_aliases_and_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ticker,Date,O,H,L,Close,Vol\nabc,2020-01-02,1,2,0.5,\"1.5\",\"1,000\"\nabc,2020-01-03,1,0.5,2,1,1\nabc,bad,1,2,1,1,1\n")
    got = readers.read_csv_bars(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.symbol, r.close, r.volume) for r in got] == [("ABC", 1.5, 1000.0)]


def test_array_payloads_of_unequal_length_give_nothing(spark):
    ok = '{"s":"ok","t":[86400],"o":[1.0],"h":[2.0],"l":[1.0],"c":[1.5],"v":[3.0]}'
    df = spark.createDataFrame([("A", ok), ("B", ok.replace("[1.0]", "[1.0,2.0]", 1)), ("C", '{"s":"error"}'), ("D", "junk")], "symbol string, payload string")
    assert [(r.symbol, str(r.trade_date), r.close) for r in readers.parse_arrays(df).collect()] == [("A", "1970-01-02", 1.5)]


def test_discovery_control(spark):
    p = [0.001, 0.02, 0.03, 0.2, 0.9]
    got = {r.p: r.q for r in statistics.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double")).collect()}
    raw = [x * 5 / (i + 1) for i, x in enumerate(p)]
    assert all(abs(got[x] - min(1.0, min(raw[i:]))) < 1e-12 for i, x in enumerate(p))


def test_grounding_finds_every_letter_for_letter_quote(spark):
    """Against plain substring search: quotes of any length, that start or end inside words, with letters beyond ASCII, nulls and repeats."""
    from tapewright.operators import text

    rng = random.Random(4)
    prose = [" ".join(rng.choice(["ab", "abc", "é", "straße", "x-y", "Big", "big", "of", "漢字"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = list(enumerate(prose)) + [(3, prose[3]), (60, None), (61, "")]
    quotes = [(i, p[a : a + rng.randint(1, 40)]) for i, p in enumerate(prose) if p for a in [rng.randrange(len(p))]] + [(70, None), (71, ""), (72, "not there at all, I am afraid"), (1, "ab")]
    got = text.grounded(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, text string")).collect()
    want = {(d, i) for d, t in docs for i, q in quotes if q and t and q in t}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_headlines_are_all_lines(spark):
    from tapewright.operators import text

    d = spark.createDataFrame([(1, "a\n\n b \n  ", "s", "en"), (2, None, None, None), (3, "", "s", "en")], "doc_id long, text string, source string, lang string")
    assert sorted((r.doc_id, r.line, r.title) for r in text.headlines(d).collect()) == [(1, 0, "a"), (1, 2, " b ")]
    assert text.headlines(d.limit(0)).collect() == []


def test_admission_with_counts_beyond_a_long(spark):
    rows = [("b", "fine", "S", 9.0, 3.0, 1.0), ("b", "tiny", "S", 8.0, 2e-15, 1e-15), ("b", "least", "T", 7.0, 5e-324, 0.0), ("b", "large", "T", 6.0, 2e-14, 1e-14), ("b", "none", "U", 5.0, 1.0, 1.0)]
    got = scoring.admit(spark.createDataFrame(rows, "book string, symbol string, sector string, score double, price double, stop double"), "book")
    assert {r.symbol: (r.admitted, r.reason, r.shares) for r in got.collect()} == {
        "fine": (True, "", 5000), "tiny": (True, "", None), "least": (True, "", None), "large": (True, "", int(1e6 * 0.01 / (2e-14 - 1e-14))), "none": (False, "no_risk", 0),
    }
