"""Outcomes of signals by regime and net of costs, features against outcomes, candles in context, proxies from closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import bands
from tapewright.functions.windows import BARS as P
from tapewright.operators import candles, cross_section, signals

#: Limits of the volatility classes, in percent of the own history at or below today's range.
VOLATILITY = [(20, "Very Low"), (40, "Low"), (60, "Normal"), (80, "High")]
#: Most points of a candle's geometry, place, trend and volume, and of a move without a trend.
GEOMETRY, PLACE, TURN, NO_TREND, EFFORT, DOJI = 25, 25, 20, 8, 15, 15


def volatility_class(bars: DataFrame, n: int = 14, history: int = 250, least: int = 20) -> DataFrame:
    """Rank of the mean true range among its own last values, this one included, and its class: never looks ahead."""
    before = P.lag("close")
    tr = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    f = bars.withColumn("tr", tr).withColumn("atr", F.round(P.full(F.avg("tr"), n, "tr"), 9))
    f = f.withColumn("past", F.collect_list("atr").over(P.W(history + 1)))
    rank = 100.0 * F.size(F.filter("past", lambda x: x <= F.col("atr"))) / F.size("past")
    f = f.withColumn("atr_rank", F.when(F.col("atr").isNotNull() & (F.size("past") >= least), rank)).drop("past")
    return f.withColumn("volatility", bands(F.col("atr_rank"), VOLATILITY, "Extreme"))


def hits_with_outcomes(bars: DataFrame, more: dict[str, Column] | None = None, horizon: int = 20) -> DataFrame:
    """Candle and range signals with the return after them in percent, and columns named in ``more``."""
    f = signals.range_frame(candles.candle_frame(bars)).withColumn("ret", 100 * (P.lead("close", horizon) / F.col("close") - 1))
    keep = ["symbol", "trade_date", "ret", *(more or {})]
    return signals.long_form(f.withColumns(more or {}), candles.CANDLES | signals.RANGE_EVENTS, keep).filter("ret IS NOT NULL")


def regime_split(bars: DataFrame, horizon: int = 20, least: int = 20) -> DataFrame:
    """Signals that have a sample of ``least`` in two or more regimes, by the market's regime and by the symbol's own
    volatility.  Regimes of the market are a row for each date."""
    market = cross_section.regimes(bars, "trade_date").select("trade_date", F.coalesce("regime", F.lit("Unknown")).alias("market"))
    hits = hits_with_outcomes(volatility_class(bars), {"volatility": F.col("volatility")}, horizon).join(market, "trade_date", "left")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("regime")) for k, v in (("market", F.coalesce("market", F.lit("Unknown"))), ("volatility", F.col("volatility")))]))
    long = hits.select("signal", "ret", kinds.alias("k")).select("k.*", "signal", "ret").filter("regime IS NOT NULL")
    stats = signals.return_stats(long, ["kind", "signal", "regime"], "ret", least).filter("NOT low_sample")
    return stats.withColumn("regimes", F.count("*").over(Window.partitionBy("kind", "signal"))).filter("regimes >= 2")


def net_of_cost(hits: DataFrame, by: list[str], ret: str, cost: float = 0.5) -> DataFrame:
    """Gross and net win rate, mean and expectancy of returns in percent; ``cost`` is what a round trip takes."""
    def parts(r: Column, name: str) -> list[Column]:
        share = F.avg((r > 0).cast("int"))
        gain, loss = F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0))
        return [F.round(100 * share, 4).alias(name + "win_rate"), F.round(F.avg(r), 4).alias(name + "avg_return"), F.round(share * gain + (1 - share) * loss, 4).alias(name + "expectancy")]

    return hits.groupBy(*by).agg(F.count("*").alias("n"), *parts(F.col(ret), ""), *parts(F.col(ret) - cost, "net_"))


def feature_correlation(hits: DataFrame, features: dict[str, Column], won: Column) -> DataFrame:
    """Correlation of yes-or-no features with an outcome, strongest first: all sums in one pass, then a row for each."""
    y = won.cast("double")
    sums = []
    for name, test in features.items():
        x = test.cast("double")
        r = F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
        sums.append(F.struct(F.lit(name).alias("feature"), F.round(r, 4).alias("correlation"), F.count_if(test).alias("n_positive")))
    return hits.agg(F.array(*sums).alias("s")).select(F.inline("s"))


def candle_context(bars: DataFrame, follow: int = 3) -> DataFrame:
    """Candle signals with points for geometry, place, trend and volume (0 to 100), and whether the bars after them
    confirmed: a further close, a close beyond the bar, and its far end held within a hundredth."""
    f = signals.range_frame(candles.candle_frame(bars)).withColumns({
        "usual": P.prior(F.avg("volume"), 20), "bars_since": F.count("close").over(P.FWD(follow)).cast("int"),
        "best": F.max("close").over(P.FWD(follow)), "worst": F.min("close").over(P.FWD(follow)), "top_after": F.max("high").over(P.FWD(follow)), "low_after": F.min("low").over(P.FWD(follow)),
    })
    keep = ["symbol", "trade_date", "high", "low", "close", "volume", "body", "trend", "sup", "res", "usual", "bars_since", "best", "worst", "top_after", "low_after"]
    h = signals.long_form(f, candles.CANDLES, keep).withColumn("bias", candles.bias(F.col("signal")))
    bull, bear = F.col("bias") == "bullish", F.col("bias") == "bearish"
    level = F.when(bull, F.col("sup")).when(bear, F.col("res"))
    away = F.abs(F.col("close") - level) / level * 100
    place = F.when(level > 0, F.greatest(F.lit(0.0), PLACE - away * 5)).otherwise(0.0)
    geometry = F.when(F.col("signal") == "Doji", float(DOJI)).otherwise(F.least(F.lit(1.0), F.col("body") * 3) * GEOMETRY)
    turn = F.when((bull & (F.col("trend") == "down")) | (bear & (F.col("trend") == "up")), TURN).when((bull | bear) & (F.col("trend") == "flat"), NO_TREND).otherwise(0)
    effort = F.coalesce(EFFORT * F.least(F.lit(1.0), F.try_divide(F.col("volume"), "usual") / 1.5), F.lit(0.0))
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    passed = lambda *tests: sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    n = F.when(bull, passed(F.col("best") > close, F.col("best") > high, F.col("low_after") >= low * 0.99)).otherwise(passed(F.col("worst") < close, F.col("worst") < low, F.col("top_after") <= high * 1.01))
    status = F.when(~(bull | bear), "N/A").when(F.col("bars_since") == 0, "Unconfirmed").when(n == 3, "Confirmed").when(n >= 1, "Partially Confirmed").otherwise("Failed")
    return h.withColumns({"context": F.least(F.lit(100.0), F.bround(F.round(geometry + place + turn + effort, 6), 0)).cast("int"), "status": status})


def eligibility(bars: DataFrame, history: int = 200, traded: float = 0.9, turnover: float = 5e6, gap: float = 15.0) -> DataFrame:
    """Why a symbol is left out of pattern scans, or null: short history, idle sessions, a small median of the mean turnover of
    20 bars, or a gap in percent without the volume for it."""
    before, usual = P.lag("close"), F.when(F.count("volume").over(P.W(20)) >= 5, F.avg("volume").over(P.W(20)))
    jump = (100 * F.abs(F.col("close") / F.nullif(before, F.lit(0.0)) - 1) > gap) & (F.col("volume") < 1.5 * usual)
    f = bars.withColumns({"turnover": P.full(F.avg(F.col("close") * F.col("volume")), 20), "jump": F.coalesce(jump, F.lit(False))})
    out = f.groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.avg((F.col("volume") > 0).cast("int")).alias("traded"), F.percentile("turnover", F.lit(0.5)).alias("turnover"), F.max("jump").alias("jump"),
    )
    why = F.when(F.col("sessions") < history, "insufficient_history").when(F.col("traded") < traded, "too_illiquid")
    why = why.when(F.coalesce(F.col("turnover") < turnover, F.lit(True)), "untradeable_turnover").when(F.col("jump"), "unadjusted_corporate_action_suspected")
    return out.withColumn("reason", why)


def close_proxies(bars: DataFrame) -> DataFrame:
    """Ranges and turns for feeds without highs and lows."""
    before = P.lag("close")
    f = bars.withColumn("move", F.abs(F.col("close") - before))
    proxy = F.greatest(F.abs(F.col("close") - F.col("open")), F.abs(F.col("open") - before), F.col("move"))
    c1, c2, c3 = (P.lag("close", n) for n in (1, 2, 3))
    turn = F.when((c3 > c2) & (c2 > c1) & (F.col("close") > c1), "bullish").when((c3 < c2) & (c2 < c1) & (F.col("close") < c1), "bearish")
    return f.withColumns({"atr_close14": P.full(F.avg("move"), 14, "move"), "range_proxy": proxy, "turn": turn})
