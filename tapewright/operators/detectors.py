"""Pattern detectors and daily signal families beyond single candles.  Rules are SQL text over named columns,
as in ``signals``; sequences that need memory are windows, and the one true automaton is a fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.windows import BARS as P
from tapewright.functions.windows import run_length
from tapewright.operators import indicators, kernels
from tapewright.operators.candles import candle_frame

#: Volume signals that need no recursive column; x_5 is x five bars before.
VOLUME_SIGNALS: dict[str, str] = {
    "MFI_OVERSOLD": "mfi < 30 AND mfi_1 >= 30", "MFI_OVERBOUGHT": "mfi > 70 AND mfi_1 <= 70",
    "OBV_CROSS_UP": "obv > obv_5 AND obv_1 <= obv_6", "OBV_CROSS_DN": "obv < obv_5 AND obv_1 >= obv_6",
    "VROC_POSITIVE": "vroc > 0 AND vroc_1 <= 0", "VROC_NEGATIVE": "vroc < 0 AND vroc_1 >= 0",
    "AD_RISING": "adl > adl_5 + 1e-6 AND close <= close_5", "AD_FALLING": "adl < adl_5 - 1e-6 AND close >= close_5",
    "VWMA_CROSS_UP": "close > vwma AND close_1 <= vwma_1", "VWMA_CROSS_DN": "close < vwma AND close_1 >= vwma_1",
}


def volume_signal_frame(bars: DataFrame) -> DataFrame:
    f = indicators.volume(indicators.oscillators(bars))
    f = f.withColumns({"mfi": F.col("mfi_null"), "vroc": F.col("vroc14"), "vwma": F.round("vwma20", 9)})
    return f.withColumns({
        **{f"{x}_1": P.lag(x) for x in ("mfi", "obv", "vroc", "vwma", "close")}, "obv_5": P.lag("obv", 5), "obv_6": P.lag("obv", 6), "adl_5": P.lag("adl", 5), "close_5": P.lag("close", 5),
    })


def pattern_frame(bars: DataFrame) -> DataFrame:
    """Columns for PATTERNS: candles, a five-close trend before the bar, prior volume, recent extremes, ATR."""
    f = candle_frame(bars).withColumn("tr", indicators.true_range())
    prev = P.base.rowsBetween(-5, -1)
    f = f.withColumns({
        "slope5": F.when(F.count("close").over(prev) == 5, F.regr_slope("close", "bar_ix").over(prev) / F.avg("close").over(prev)),
        "vol20": P.prior(F.avg("volume"), 20), "high20": P.prior(F.max("high"), 20), "low20": P.prior(F.min("low"), 20), "atr14": P.full(F.avg("tr"), 14),
        "rise10": P.lag("close", 1) / P.lag("close", 10) - 1, "d1": F.datediff("trade_date", P.lag("trade_date")), "d2": F.datediff("trade_date", P.lag("trade_date", 2)),
    })
    return f


#: pattern -> rule.  Geometry, then context.
PATTERNS: dict[str, str] = {
    "BULL_ENGULF_STRICT": "c1 < o1 AND c > o AND o < c1 AND c > o1 AND slope5 < -0.001",
    "BULL_ENGULF_BOUNDARY": "c1 < o1 AND c > o AND o <= c1 AND c >= o1 AND (o = c1 OR c = o1) AND slope5 < -0.001",
    "BEAR_ENGULF": "c1 > o1 AND c < o AND o >= c1 AND c <= o1 AND slope5 > 0.001 AND volume >= 1.3 * vol20 AND h >= 0.97 * high20",
    "THREE_LINE_STRIKE": "c3 > o3 AND c2 > o2 AND c1 > o1 AND c2 > c3 AND c1 > c2 AND c < o AND o >= c1 AND c <= o3 AND rise10 >= 0.02",
    "FIVE_BAR_BULL": "c4 < o4 AND greatest(h1, h2, h3) <= h4 AND least(l1, l2, l3) >= l4 AND c > h4",
    "FIVE_BAR_BEAR": "c4 > o4 AND greatest(h1, h2, h3) <= h4 AND least(l1, l2, l3) >= l4 AND c < l4",
    "MORNING_STAR": "c2 < o2 AND len2 > 0.5 * atr14 AND len1 < 0.4 * len2 AND c > o AND c > (o2 + c2) / 2 AND d2 <= 8 AND (slope5 < 0 OR l1 <= low20)",
    "EVENING_STAR": "c2 > o2 AND len2 > 0.5 * atr14 AND len1 < 0.4 * len2 AND c < o AND c < (o2 + c2) / 2 AND d2 <= 8 AND (slope5 > 0 OR h1 >= high20)",
    "INSIDE_BAR": "h <= h1 AND l >= l1", "OUTSIDE_BAR": "NOT (h <= h1 AND l >= l1) AND h >= h1 AND l <= l1",
    "BULL_TREND_BAR": "body > 0.6 AND white", "BEAR_TREND_BAR": "body > 0.6 AND black",
}


#: Patterns that are traded short.
SHORT = frozenset({"BEAR_ENGULF", "THREE_LINE_STRIKE", "FIVE_BAR_BEAR", "EVENING_STAR", "BEAR_TREND_BAR"})


def trade_levels(hits: DataFrame, short: frozenset[str] = SHORT) -> DataFrame:
    """Entry, a stop one ATR beyond the bar, and targets at one and two times the risk."""
    bear = F.col("signal").isin(*sorted(short))
    stop = F.when(bear, F.col("h") + F.col("atr14")).otherwise(F.col("l") - F.col("atr14"))
    risk = F.abs(F.col("c") - stop)
    side = F.when(bear, -1).otherwise(1)
    return hits.withColumns({"stop": stop, "target1": F.col("c") + side * risk, "target2": F.col("c") + 2 * side * risk})


def trend_strength(bars: DataFrame, n: int = 10) -> DataFrame:
    """Closes near the top of the bar, overlap with the bar before, and follow-through over n bars, as a score."""
    rng = F.greatest(F.lit(0.0001), F.col("high") - F.col("low"))
    f = bars.withColumns({
        "near": ((F.col("close") - F.col("low")) / rng >= 0.65).cast("int"),
        "overlap": F.greatest(F.lit(0.0), F.least("high", P.lag("high")) - F.greatest("low", P.lag("low"))) / rng,
    })
    over = F.avg("overlap").over(P.W(n - 1))
    f = f.withColumns({"near_n": P.full(F.sum("near"), n), "over": over, "first": P.lag("close", n - 1)})
    score = 100 * (0.5 * F.col("near_n") / n + 0.3 * (1 - F.least(F.lit(1.0), "over")) + 0.2 * (F.col("close") > F.col("first")).cast("int"))
    return f.withColumn("strength", F.when(F.col("near_n").isNotNull(), score))


def contractions(bars: DataFrame, least: int = 2) -> DataFrame:
    """Maximal runs of inside bars with how tight and how dry they are, and the first close above them within ten bars."""
    f = bars.withColumns({"inside": F.coalesce((F.col("high") <= P.lag("high")) & (F.col("low") >= P.lag("low")), F.lit(False)), "vol20": P.prior(F.avg("volume"), 20)})
    f = run_length(f, F.col("inside"), "run")
    f = f.withColumns({"ends": (F.col("run") >= least) & (F.coalesce(P.lead("run"), F.lit(0)) == 0), "highs": F.collect_list("high").over(P.W(40)), "lows": F.collect_list("low").over(P.W(40)), "next": F.collect_list(F.struct("bar_ix", "close")).over(P.FWD(10))})
    at = F.size("highs") - F.col("run")
    r = f.filter(F.col("ends") & (at >= 1)).withColumns({"top": F.element_at("highs", at.cast("int")), "bottom": F.element_at("lows", at.cast("int"))})
    up = F.array_min(F.transform(F.filter("next", lambda s: s["close"] > F.col("top")), lambda s: s["bar_ix"]))
    return r.select("symbol", "trade_date", "bar_ix", F.col("run").alias("length"), ((F.col("high") - F.col("low")) / F.col("close")).alias("tightness"), F.try_divide(F.col("volume"), F.col("vol20")).alias("dryness"), "top", "bottom", (up - F.col("bar_ix")).alias("breakout_after"))


def three_line_strikes(
    bars: DataFrame, rise: float = 0.05, back: int = 10, volume_ratio: float = 1.3, atr_share: float = 0.5, least_buffer: float = 0.005
) -> DataFrame:
    """Three falling black bars after a rise, and a white one that takes them all back.  ``is_valid`` wants volume too; the stop lies under the
    four bars by a share of the ATR or of the price, the targets one and two times their height above."""
    f = candle_frame(bars).withColumn("tr", indicators.true_range())
    f = f.withColumns({"vol20": P.prior(F.avg("volume"), 20), "atr14": P.full(F.avg("tr"), 14), "before": P.lag("close", 3 + back)})
    geometry = "c3 < o3 AND c2 < o2 AND c2 < c3 AND c1 < o1 AND c1 < c2 AND c > o AND o <= c1 AND c >= o3"
    f = f.filter(F.expr(geometry) & ((F.col("o3") - F.col("before")) / F.col("before") >= rise))
    low = F.least("l", "l1", "l2", "l3")
    return f.select(
        "symbol", "trade_date", F.coalesce(F.col("volume") >= volume_ratio * F.col("vol20"), F.lit(False)).alias("is_valid"), F.col("c").alias("entry"),
        (low - F.greatest(atr_share * F.col("atr14"), least_buffer * F.col("c"))).alias("stop"), (F.col("c") + F.col("h") - low).alias("target1"), (F.col("c") + 2 * (F.col("h") - low)).alias("target2"),
    )


def impulse_pullbacks(bars: DataFrame, first: int = 3, last: int = 45) -> DataFrame:
    """Bars ``first`` to ``last`` after an impulse (MFI and OBV both strong on an up day) that have given back part of it while
    ranges shrank; the newest impulse wins.  The pairing is an equi-join on the symbol and blocks of bar
    numbers, so no symbol's history is paired with itself."""
    f = indicators.volume(indicators.oscillators(bars)).withColumn("tr", indicators.true_range())
    f = f.withColumns({"atr5": P.full(F.avg("tr"), 5), "atr20": P.full(F.avg("tr"), 20), "obv_max": P.prior(F.max("obv"), 20)})
    day0 = f.filter((F.col("mfi_null") >= 60) & (F.col("obv") > F.col("obv_max")) & (F.col("close") > F.col("open"))).select(
        F.col("symbol").alias("s0"), F.col("bar_ix").alias("ix0"), F.col("close").alias("c0"), F.col("low").alias("l0"), F.explode(F.array(F.floor(F.col("bar_ix") / (last + 1)), F.floor(F.col("bar_ix") / (last + 1)) + 1)).alias("block"),
    )
    today = f.withColumn("block", F.floor(F.col("bar_ix") / (last + 1))).select("symbol", "trade_date", "bar_ix", "close", "atr5", "atr20", "block")
    j = today.join(day0, (today.symbol == day0.s0) & (today.block == day0.block) & (today.bar_ix - day0.ix0).between(first, last))
    give = (F.col("c0") - F.col("close")) / F.col("c0")
    j = j.filter(give.between(0.005, 0.05) & (F.col("close") > F.col("l0") * 0.98) & (F.col("atr5") < F.col("atr20")))
    return j.groupBy("symbol", "trade_date").agg(F.max("ix0").alias("ix0"), F.first("bar_ix").alias("bar_ix"), F.max_by("c0", "ix0").alias("c0"), F.first("close").alias("close"))


def stealth_accumulation(bars: DataFrame) -> DataFrame:
    """Consolidation, dry supply with memory, absorption with memory and OBV rising over flat prices, gated by MACD."""
    f = kernels.recursive(bars)
    obv_step = F.coalesce(F.signum(F.col("close") - P.lag("close")), F.lit(0.0)) * F.col("volume")
    f = f.withColumns({"step": obv_step, "v20": P.full(F.avg("volume"), 20), "hi20": P.full(F.max("high"), 20), "lo20": P.full(F.min("low"), 20)}).withColumn("obv", P.cum(F.sum("step")))
    f = f.withColumns({
        "cons_pct": (F.col("hi20") - F.col("lo20")) / F.col("lo20"), "dry": (F.col("volume") < 0.7 * F.col("v20")).cast("int"),
        "absorb": (F.col("volume") >= 1.5 * F.col("v20")) & (F.abs(F.col("close") - F.col("open")) <= 0.5 * F.col("atr_wilder")),
        "obv_slope": F.try_divide(P.full(F.regr_slope("obv", "bar_ix"), 20), P.full(F.stddev_pop("obv"), 20)), "px_slope": F.try_divide(P.full(F.regr_slope("close", "bar_ix"), 20), P.full(F.stddev_pop("close"), 20)),
        "hist_1": P.lag("macd_hist"),
    })
    f = f.withColumn("exhausted", F.coalesce(F.sum("dry").over(P.W(10)) >= 5, F.lit(False)))
    no = F.lit(False)
    f = f.withColumns({
        "consolidating": F.coalesce(F.col("cons_pct") <= 0.12, no), "dry_supply": P.memory(F.col("exhausted"), 5), "absorption": F.coalesce(P.memory(F.coalesce(F.col("absorb"), no), 10), no),
        "divergence": F.coalesce((F.col("obv_slope") > 0.05) & (F.col("px_slope") <= 0.02), no),
        "macd_ok": F.coalesce((F.col("macd") > F.col("macd_signal")) | ((F.col("macd_hist") > 0) & (F.col("macd_hist") > F.col("hist_1"))), no),
    })
    f = f.withColumn("score", 30 * F.col("dry_supply").cast("int") + 30 * F.col("absorption").cast("int") + 40 * F.col("divergence").cast("int"))
    gate = F.col("consolidating") & F.col("macd_ok")
    return f.withColumn("signal_type", F.when(gate & (F.col("score") >= 100), "EXTREME").when(gate & (F.col("score") >= 60), "READY").when(gate & (F.col("score") >= 30), "WATCH").otherwise("NO_SIGNAL"))


STAGES = ("none", "compression", "squeeze", "attempt", "confirmed", "failed")


def stages(bars: DataFrame) -> DataFrame:
    """Compression, squeeze, breakout attempt, then confirmed or failed: each state depends on the one before, so a
    symbol's bars go through one fold; its inputs are windows."""
    f = indicators.squeeze(bars)
    f = f.withColumns({"sd": P.full(F.stddev_samp("close"), 20), "hi20": P.prior(F.max("high"), 20), "lo20": P.prior(F.min("low"), 20), "rvol": F.col("volume") / P.prior(F.avg("volume"), 20)})
    f = f.withColumn("tight", F.coalesce(4 * F.col("sd") / F.col("sma20") < 0.06, F.lit(False))).select("symbol", "trade_date", "bar_ix", "close", "hi20", "lo20", "rvol", "tight", "squeezed")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ix", ignore_index=True)
        state, level, age, out = 0, 0.0, 0, []
        for close, high, rvol, tight, squeezed in pdf[["close", "hi20", "rvol", "tight", "squeezed"]].itertuples(index=False):
            age += 1
            if state in (1, 2) and high == high and close > high and (rvol or 0) >= 1.2:
                state, level, age = 3, high, 0
            elif state == 3 and (close < level or age >= 3):
                state, age = (5 if close < level else 4), 0
            elif state in (4, 5) and age >= 10:
                state, age = 0, 0
            elif state in (0, 1, 2):
                new = 2 if squeezed and tight else 1 if tight else 0
                state, age = new, age if new == state else 0
            out.append(state)
        return pd.DataFrame({"symbol": pdf["symbol"], "trade_date": pdf["trade_date"], "stage": np.array(STAGES)[out]})

    return f.groupBy("symbol").applyInPandas(fold, "symbol string, trade_date date, stage string")


def state_changes(bars: DataFrame) -> DataFrame:
    """Days on which a state flips: the price over its 20-bar mean, and the faster Ichimoku line over the slower."""
    f = indicators.trend(bars)
    s = f.withColumns({"above20": F.col("close") > F.col("sma20"), "tk": F.col("tenkan") > F.col("kijun")})
    out = None
    for name in ("above20", "tk"):
        part = s.withColumn("before", P.lag(name)).filter(F.col(name).isNotNull() & F.col("before").isNotNull() & (F.col(name) != F.col("before")))
        part = part.select("symbol", "trade_date", F.lit(name).alias("state"), F.col(name).alias("now"))
        out = part if out is None else out.unionByName(part)
    return out


def edges(bars: DataFrame) -> DataFrame:
    """Breakouts above 20 bars on relative volume beyond its own 90th percentile that hold for three bars."""
    f = bars.withColumns({"rvol": F.col("volume") / P.prior(F.avg("volume"), 20), "hi20": P.prior(F.max("high"), 20)})
    f = f.withColumn("p90", P.prior(F.percentile("rvol", F.lit(0.9)), 60, "rvol"))
    held = (P.lead("close", 1) > F.col("hi20")) & (P.lead("close", 2) > F.col("hi20")) & (P.lead("close", 3) > F.col("hi20"))
    return f.withColumn("held", held).filter((F.col("rvol") > F.col("p90") + 1e-9) & (F.col("close") > F.col("hi20")) & F.col("held"))


def cliffs(bars: DataFrame, drop: float = 0.97, spike: float = 1.5) -> DataFrame:
    """Bars from each symbol's last price cliff on (a close far below the one before, on volume far above its mean)."""
    f = bars.withColumn("cliff", F.coalesce((F.col("close") <= drop * P.lag("close")) & (F.col("volume") > spike * F.avg("volume").over(P.WP(10))), F.lit(False)))
    last = F.max(F.when(F.col("cliff"), F.col("bar_ix"))).over(Window.partitionBy("symbol"))
    return f.withColumn("last", last).filter(F.col("last").isNull() | (F.col("bar_ix") >= F.col("last"))).drop("last")
