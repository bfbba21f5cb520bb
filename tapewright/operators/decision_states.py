"""Signals with memory: a score's band, held by the signal of the bar before, then gates that only make it more careful.

The next signal depends on the last one in three places (the dead band, the confirmation of a strong signal, and
whether a breakdown is an exit), so a bar is a map from each last signal to the next one.  Maps are folded
along the symbol by :func:`tapewright.functions.scans.automaton`, and a history is recomputed in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import scans
from tapewright.functions.scalars import clamp
from tapewright.functions.windows import BARS as P
from tapewright.operators.cross_section import index_series
from tapewright.operators.scoring import technical_score

#: The signals, weakest band first; the last is before any bar.
SIGNALS = ("Avoid", "Hold", "Watch", "Buy", "Strong Buy", "Exit", "No data", "none")
AVOID, HOLD, WATCH, BUY, STRONG, EXIT, NO_DATA, NONE = range(len(SIGNALS))


@dataclass(frozen=True)
class Rules:
    """Fixed values as defaults: the lower limits of the bands and the limits of the gates."""

    strong_buy: float = 80.0
    buy: float = 70.0
    watch: float = 60.0
    hold: float = 50.0
    #: Points beyond a limit that an upgrade by one band must reach; 0: no dead band.
    band: float = 0.0
    chase_guard: bool = False
    most_extended: float = 10.0
    most_momentum: float = 15.0
    #: How far the chase limits widen in a rising market, and how far above its mean an index must be for all of it.
    widen: float = 1.0
    widen_full: float = 8.0
    regime_gate: bool = False
    earnings_days: int = 5
    least_confidence: float = 45.0
    least_flow: float = 0.0
    least_strength: float = -20.0


def band_of(score: Column, rules: Rules) -> Column:
    return F.when(score >= rules.strong_buy, STRONG).when(score >= rules.buy, BUY).when(score >= rules.watch, WATCH).when(score >= rules.hold, HOLD).otherwise(AVOID)


def bar_flags(rules: Rules) -> dict[str, Column]:
    """What a bar says whatever the last signal: its band, whether its price ran away, and whether a gate is shut."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    band = band_of(F.col("score"), rules)
    rising = yes(F.col("index_above") > 0)
    wide = F.when(rising, 1 + (rules.widen - 1) * clamp(F.col("index_above") / rules.widen_full, 0, 1)).otherwise(1.0)
    chased = yes(F.col("extension") > rules.most_extended * wide) | yes(F.col("momentum") > rules.most_momentum * wide)
    gates = [
        F.col("earnings_in").between(0, rules.earnings_days), F.col("concentrated"), F.col("poor_reward"), F.col("confidence") < rules.least_confidence,
        F.col("flow") <= rules.least_flow, F.col("strength") < rules.least_strength,
    ] + ([F.col("index_above") <= 0] if rules.regime_gate else [])
    return {
        "__band": F.when((band == STRONG) & ~yes(F.col("confirming")), BUY).otherwise(band),
        "__chased": chased if rules.chase_guard else F.lit(False),
        "__gated": F.exists(F.array(*[yes(g) for g in gates]), lambda g: g),
        "__down": yes(F.col("breakdown")), "__usable": yes(F.col("price") > 0), "__ranked": yes(F.col("eligible")),
    }


def next_signals(rules: Rules) -> Column:
    """The signal after a bar for each last signal, from :func:`bar_flags` and the score."""
    band, score = F.col("__band"), F.col("score")
    limits = F.array(*[F.lit(x) for x in (0.0, rules.hold, rules.watch, rules.buy, rules.strong_buy, 0.0, 0.0, 0.0)])
    known = lambda last: last <= STRONG
    every = F.array(*[F.lit(s) for s in range(len(SIGNALS))])
    # one band down: the old signal stays while its own limit is met; one band up: the new limit must be passed by the dead band
    falls = lambda last: known(last) & (last - band == 1) & (score >= F.get(limits, last))
    grazes = lambda last: known(last) & (band - last == 1) & (score < F.get(limits, band) + rules.band)
    held = F.transform(every, lambda last: F.when(falls(last) | grazes(last), last).otherwise(band)) if rules.band > 0 else F.array_repeat(band, len(SIGNALS))
    # a strong signal is confirmed by a second bar
    sure = F.transform(held, lambda h, last: F.when((h == STRONG) & (last != STRONG), BUY).otherwise(h))
    slow = F.transform(sure, lambda h: F.when(F.col("__chased") & (h >= BUY), h - 1).otherwise(h))
    careful = F.transform(slow, lambda h: F.when(F.col("__gated") & (h >= BUY), WATCH).otherwise(h))
    return F.transform(careful, lambda h, last: F.when(~F.col("__usable"), NO_DATA)
        .when(F.col("__down"), F.when(last.isin(BUY, STRONG, HOLD), EXIT).otherwise(AVOID))
        .when(~F.col("__ranked"), AVOID).otherwise(h))


def signal_states(inputs: DataFrame, rules: Rules = Rules(), start: str = "none", key: str = "symbol", order: str = "bar_ix", block: int = scans.BLOCK) -> DataFrame:
    """``inputs`` with ``signal`` and ``last_signal`` (null on the first bar), from the signal ``start``, as stored before them.  A strong
    signal wants a strong one before it, so one goes on but none begins: the last signal is the one given out.  Columns read: price, eligible, breakdown, score,
    confirming, extension, momentum, index_above (percent above the index's mean), earnings_in, concentrated, poor_reward, confidence,
    flow, strength.  A breakdown comes before eligibility; null gates do not act; a null score is the lowest band."""
    flagged = inputs.withColumns(bar_flags(rules))
    out = scans.automaton(flagged.withColumn("__to", next_signals(rules)), F.col("__to"), SIGNALS.index(start), "__state", key, order, block)
    names = F.array(*[F.lit(s) for s in SIGNALS])
    last = F.lag("__state").over(Window.partitionBy(key).orderBy(order))
    return out.withColumns({"signal": F.get(names, F.col("__state")), "last_signal": F.get(names, last)}).select(*inputs.columns, "signal", "last_signal")


def early_watch(score: Column, flow: Column, breakdown: Column, price: Column, support: Column, strength: Column, band=(55.0, 70.0), least_flow: float = 0.05, least_strength: float = -20.0) -> Column:
    """A name that builds up below the buying band: money flows in and its structure holds."""
    ok = (flow > least_flow) & (score >= band[0]) & (score < band[1]) & ~F.coalesce(breakdown, F.lit(False)) & (price > support) & F.coalesce(strength >= least_strength, F.lit(True))
    return F.coalesce(ok, F.lit(False))


def agreement(close: Column, ema50: Column, rsi: Column, macd_hist: Column, obv_up: Column, support: Column, breakdown: Column) -> Column:
    """Which of trend, momentum, volume and structure speak for a rise."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    votes = [("trend", close > ema50), ("momentum", rsi.between(40, 74) & (macd_hist > 0)), ("volume", obv_up), ("structure", (close > support) & ~yes(breakdown))]
    return F.array_compact(F.array(*[F.when(yes(c), F.lit(n)) for n, c in votes]))


def signal_inputs(bars: DataFrame, least_volume: float = 20.0) -> DataFrame:
    """What the rules read, from daily bars: the technical score, the distance to the 50-bar exponential mean, and the equal-weight
    index against its own."""
    f = technical_score(bars)
    f = f.select(
        "symbol", "trade_date", "bar_ix", F.col("close").alias("price"), "score", (100 * F.col("coverage")).alias("confidence"), F.col("cmf20").alias("flow"), "lo20",
        (F.coalesce(F.avg("volume").over(P.WP(20)), F.lit(0.0)) >= least_volume).alias("eligible"), (F.col("close") < F.col("lo20")).alias("breakdown"),
        ((F.col("close") > F.col("sma50")) & (F.col("rsi_simple_100") >= 50)).alias("confirming"), (100 * (F.col("close") / P.lag("close", 20) - 1)).alias("momentum"),
        (F.try_divide(F.col("hi20") - F.col("close"), F.col("close") - F.col("lo20")) < 0.25).alias("poor_reward"), "rsi_simple_100", (F.col("obv") > F.col("obv_20")).alias("obv_up"),
    )
    alphas = {"ema50": 2 / 51, "ema12": 2 / 13, "ema26": 2 / 27}
    f = scans.ewma(f, {n: (F.col("price"), a) for n, a in alphas.items()})
    f = f.withColumn("macd", F.col("ema12") - F.col("ema26"))
    f = scans.ewma(f, {"macd_signal": (F.col("macd"), 0.2)}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    # one row a date: the index is small whatever the number of symbols
    index = scans.ewma(index_series(bars, "trade_date").withColumn("__all", F.lit(1)), {"index_ema": (F.col("index_level"), 2 / 51)}, key="__all", order="trade_date")
    day = Window.orderBy("trade_date")
    index = index.select("trade_date", (100 * (F.col("index_level") / F.col("index_ema") - 1)).alias("index_above"), (100 * (F.col("index_level") / F.lag("index_level", 20).over(day) - 1)).alias("index_momentum"))
    f = f.join(index, "trade_date", "left")
    return f.withColumns({
        "extension": 100 * (F.col("price") / F.col("ema50") - 1), "strength": F.col("momentum") - F.col("index_momentum"),
        "earnings_in": F.lit(None).cast("int"), "concentrated": F.lit(None).cast("boolean"),
    })
