"""Further indicator variants, level breaks, break-down conditions, trailing stops and formula strategies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.windows import BARS as P
from tapewright.functions.windows import asof_backward
from tapewright.operators import indicators
from tapewright.operators.kernels import _per_symbol, ewma, true_range
from tapewright.operators.pivots import pivots


def mfi_derivatives(bars: DataFrame) -> DataFrame:
    """Changes of the money flow index over 5 and 15 bars, its slope, and the slope of the later half less that of the earlier."""
    f = indicators.oscillators(bars).withColumn("mfi", F.col("mfi_50"))
    half2, half1 = P.base.rowsBetween(-6, 0), P.base.rowsBetween(-13, -7)
    ok = F.count("mfi").over(P.W(14)) == 14
    f = f.withColumns({"d5": F.col("mfi") - P.lag("mfi", 5), "d15": F.col("mfi") - P.lag("mfi", 15), "slope15": P.full(F.regr_slope("mfi", "bar_ix"), 15, "mfi")})
    return f.withColumn("accel", F.when(ok, F.regr_slope("mfi", "bar_ix").over(half2) - F.regr_slope("mfi", "bar_ix").over(half1)))


def ema_variants(bars: DataFrame) -> DataFrame:
    """An EMA with normalised weights, an ATR started with the mean of its first 14 true ranges, an EMA of only the
    last 26 closes, and the force index."""

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        c, h, lo, v = (pdf[x].to_numpy(float) for x in ("close", "high", "low", "volume"))
        a = 2 / 27
        num = den = 0.0
        adj = np.empty(len(c))
        for i, x in enumerate(c):
            num, den = num * (1 - a) + x, den * (1 - a) + 1
            adj[i] = num / den
        tr = true_range(h, lo, c)
        seeded = np.full(len(c), np.nan)
        if len(c) >= 14:
            seeded[13] = y = tr[:14].mean()
            for i in range(14, len(c)):
                y += (tr[i] - y) / 14
                seeded[i] = y
        last = np.full(len(c), np.nan)
        for i in range(25, len(c)):
            y = c[i - 25]
            for x in c[i - 24 : i + 1]:
                y += a * (x - y)
            last[i] = y
        return pdf.assign(ema26_adj=adj, atr14_seeded=seeded, ema26_last=last, force13=ewma(np.diff(c, prepend=c[:1]) * v, 2 / 14))

    return _per_symbol(bars, columns, "ema26_adj double, atr14_seeded double, ema26_last double, force13 double")


def level_breaks(bars: DataFrame, zone: float = 0.01) -> DataFrame:
    """Closes beyond a level that the last three confirmed highs (or lows) share within ``zone``, by twice the zone;
    where both break, resistance is reported."""
    p = pivots(bars)
    w = Window.partitionBy("symbol", "kind").orderBy("bar_ix")
    t = p.withColumns({"p1": F.lag("price", 1).over(w), "p2": F.lag("price", 2).over(w)}).filter("p2 is not null")
    t = t.withColumns({"top": F.greatest("price", "p1", "p2"), "bottom": F.least("price", "p1", "p2")}).withColumn("tight", F.col("top") / F.col("bottom") - 1 <= zone)
    b = bars.select("symbol", "trade_date", "bar_ix", "close")
    for kind, name in (("H", "high"), ("L", "low")):
        side = t.filter(F.col("kind") == kind).select("symbol", F.col("confirmed_ix").alias("at"), F.struct("top", "bottom", "tight").alias(name))
        b = asof_backward(b, side, "bar_ix", "at", ["symbol"], [name])
    up = F.col("high.tight") & (F.col("close") > F.col("high.top") * (1 + 2 * zone))
    down = F.col("low.tight") & (F.col("close") < F.col("low.bottom") * (1 - 2 * zone))
    b = b.withColumn("side", F.when(F.coalesce(up, F.lit(False)), "resistance").when(F.coalesce(down, F.lit(False)), "support"))
    return b.filter("side is not null").withColumn("level", F.when(F.col("side") == "resistance", F.col("high.top")).otherwise(F.col("low.bottom")))


#: condition -> rule, on bars that close below the lowest low of the 20 bars before.
BREAK_CONDITIONS: dict[str, str] = {
    "any_break": "true", "high_volume": "rvol >= 1.5", "low_volume": "rvol < 0.8", "close_near_low": "pos <= 0.25", "wide_bar": "tr >= 1.5 * atr14", "below_sma50": "close < sma50",
    "oversold": "rsi_simple_100 < 30", "not_oversold": "rsi_simple_100 >= 30", "outflow": "cmf20 < 0", "below_band": "close < bb_low", "down_before": "roc10 < -0.03", "flat_before": "abs(roc10) <= 0.01",
}


def support_breaks(bars: DataFrame, horizon: int = 10) -> DataFrame:
    f = indicators.volume(indicators.oscillators(indicators.trend(bars))).withColumn("tr", indicators.true_range())
    f = f.withColumns({
        "lo20": P.prior(F.min("low"), 20), "rvol": F.col("volume") / P.prior(F.avg("volume"), 20), "pos": F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))),
        "atr14": P.full(F.avg("tr"), 14), "fwd": P.lead("close", horizon) / F.col("close") - 1,
    })
    return f.filter("close < lo20 and fwd is not null")


def trailing_trades(bars: DataFrame, distance: float = 2.0, horizon: int = 20) -> DataFrame:
    """Breakouts above 20 bars, in at the next open; a stop trails the highest high since entry by a fixed number of
    ATRs (those of the signal bar), so it is a running maximum, not a recursion.  A bar that reaches the stop set by the bars before it is out there,
    or at its open if that is lower."""
    f = bars.withColumn("tr", indicators.true_range()).withColumns({"hi20": P.prior(F.max("high"), 20), "atr14": P.full(F.avg("tr"), 14), "path": F.collect_list(F.struct("bar_ix", "open", "high", "low", "close")).over(P.FWD(horizon))})
    f = f.filter((F.col("close") > F.col("hi20")) & F.col("atr14").isNotNull() & (F.size("path") == horizon)).withColumns({"entry": F.col("path")[0]["open"], "gap": distance * F.col("atr14")})
    start = F.struct(F.col("entry").alias("top"), F.lit(None).cast("double").alias("exit"), F.lit(0).alias("bars"))
    step = lambda a, s: F.when(a["exit"].isNotNull(), a).otherwise(F.struct(
        F.greatest(a["top"], s["high"]).alias("top"), F.when(s["low"] <= a["top"] - F.col("gap"), F.least(s["open"], a["top"] - F.col("gap"))).alias("exit"), (a["bars"] + 1).alias("bars"),
    ))
    f = f.withColumn("end", F.aggregate("path", start, step))
    return f.select("symbol", "trade_date", "entry", F.coalesce("end.exit", F.col("path")[horizon - 1]["close"]).alias("exit"), F.col("end.bars").alias("bars"), F.col("end.exit").isNotNull().alias("stopped"))


#: A formula is nested tuples: (operator, left, right), ("neg", x), a terminal's name or a number.
FORMULA = ("add", ("mul", "z_mom", 0.6), ("sub", ("if_gt", "z_vol", "z_mom", "z_rng"), ("mul", 0.3, "z_rng")))


def compile_formula(tree) -> Column:
    """Expression tree to column."""
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    if isinstance(tree, str):
        return F.col(tree)
    op, *args = tree
    x = [compile_formula(a) for a in args]
    return {
        "add": lambda: x[0] + x[1], "sub": lambda: x[0] - x[1], "mul": lambda: x[0] * x[1], "div": lambda: F.when(F.abs(x[1]) > 1e-9, x[0] / x[1]).otherwise(1.0),
        "neg": lambda: -x[0], "tanh": lambda: F.tanh(x[0]), "if_gt": lambda: F.when(x[0] > x[1], x[0]).otherwise(x[2]),
    }[op]()


def formula_strategy(bars: DataFrame, tree=FORMULA, band: float = 0.25) -> DataFrame:
    """The formula over causal z-scores, squeezed to weights in [-1, 1]; the weight is held unless it moves by the band
    against the raw weight of the bar before; returns come from the weight of the bar before."""
    z = lambda c: F.try_divide(F.col(c) - P.full(F.avg(c), 60, c), P.full(F.stddev_samp(c), 60, c))
    f = bars.withColumns({"mom": F.col("close") / P.lag("close", 10) - 1, "rng": F.col("high") / F.col("low") - 1})
    f = f.withColumns({"z_mom": z("mom"), "z_vol": z("volume"), "z_rng": z("rng")}).withColumn("raw", F.tanh(compile_formula(tree)))
    moved = F.when(P.lag("raw").isNull() | (F.abs(F.col("raw") - P.lag("raw")) >= band), F.col("raw"))
    f = f.withColumn("moved", moved).withColumn("weight", F.last("moved", ignorenulls=True).over(P.CUM))
    return f.withColumn("ret", P.lag("weight") * (F.col("close") / P.lag("close") - 1))
