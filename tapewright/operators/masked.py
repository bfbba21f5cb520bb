"""Indicators that smooth over bars they must not count: ranges without locked bars, Wilder's RSI in its variants, and two
regressions over the pivots of a trailing window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import scans
from tapewright.functions.windows import BARS as P
from tapewright.operators import indicators
from tapewright.operators.pivots import pivots


def locked_bars(bars: DataFrame, thin: float = 0.1) -> DataFrame:
    """Adds ``is_locked``: a bar without range whose volume is under ``thin`` of the symbol's median of traded bars.

    The median is one number for each symbol over its whole history, from a grouped percentile, so it looks ahead as an audit of stored
    bars does."""
    median = bars.filter("volume > 0").groupBy("symbol").agg(F.percentile("volume", F.lit(0.5)).alias("__median"))
    out = bars.join(median, "symbol", "left")
    limit = F.when(F.col("__median") > 0, thin * F.col("__median")).otherwise(1.0)
    return out.withColumn("is_locked", F.coalesce((F.col("high") == F.col("low")) & (F.col("volume") < limit), F.lit(False))).drop("__median")


def locked_atr(bars: DataFrame, n: int = 14, volume_bars: int = 20, least: int = 10) -> DataFrame:
    """Wilder's ATR and the mean volume without locked bars: the ATR is carried over them, and is null until n bars counted."""
    f = locked_bars(bars).withColumn("__tr", F.when(~F.col("is_locked"), indicators.true_range()))
    f = f.withColumn("__v", F.when(~F.col("is_locked"), F.col("volume")))
    mean = F.when(F.count("__v").over(P.W(volume_bars)) >= least, F.avg("__v").over(P.W(volume_bars)))
    f = f.withColumn("avg_volume_unlocked", mean)
    out = scans.ewma(f, {"atr_unlocked": (F.col("__tr"), 1 / n)}, least=n)
    return out.drop("__tr", "__v")


def rsi_variants(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's RSI from the first change on: ``rsi_50`` is 50 where it is not defined (no change yet, or no fall so far), ``rsi_100`` is null
    until n changes were seen and 100 without a fall."""
    f = bars.withColumn("__d", F.col("close") - P.lag("close"))
    f = f.withColumns({"__up": F.greatest(F.col("__d"), F.lit(0.0)), "__down": F.greatest(-F.col("__d"), F.lit(0.0)), "__seen": F.count("__d").over(P.CUM)})
    f = f.withColumns({x: F.when(F.col("__d").isNotNull(), F.col(x)) for x in ("__up", "__down")})
    f = scans.ewma(f, {"__gain": (F.col("__up"), 1 / n), "__loss": (F.col("__down"), 1 / n)})
    rsi = F.when(F.col("__loss") != 0, 100 - 100 / (1 + F.col("__gain") / F.col("__loss")))
    f = f.withColumns({
        "rsi_50": F.coalesce(rsi, F.lit(50.0)),
        "rsi_100": F.when(F.col("__seen") >= n, F.when(F.col("__loss") == 0, 100.0).otherwise(rsi)),
    })
    return f.select(*bars.columns, "rsi_50", "rsi_100")


def regression_triangles(
    bars: DataFrame, lookback: int = 40, k: int = 3, most_high_drift: float = 0.8, least_low_drift: float = 2.0, least_r2: float = 0.7,
    least_pivots: int = 2, buffer: float = 0.01, reward: float = 3.0,
) -> DataFrame:
    """Bars whose confirmed pivots of the last ``lookback`` bars squeeze: the highs' regression line hardly rises, the lows' one does, and both
    fit.  Drifts are percents of the mean price over the lookback.  Each rail is a regression over the window's frame with nulls
    where there is no pivot, so no bar carries a list of pivots: a pivot at bar p is known at p + k, hence the frame ends k
    bars back."""
    p = pivots(bars, k).groupBy("symbol", "bar_ix").agg(*[F.max(F.when(F.col("kind") == x, F.col("price"))).alias(f"__{x}") for x in "HL"])
    f = bars.join(p, ["symbol", "bar_ix"], "left")
    w = Window.partitionBy("symbol").orderBy("bar_ix").rowsBetween(-lookback, -k)
    for x in "HL":
        y = F.col(f"__{x}")
        f = f.withColumns({
            f"__n{x}": F.count(y).over(w), f"__m{x}": F.avg(y).over(w), f"__s{x}": F.regr_slope(y, F.col("bar_ix")).over(w),
            f"__r{x}": F.when(F.max(y).over(w) == F.min(y).over(w), 1.0).otherwise(F.regr_r2(y, F.col("bar_ix")).over(w)),
        })
    f = f.withColumns({
        "high_drift": 100 * lookback * F.col("__sH") / F.col("__mH"), "low_drift": 100 * lookback * F.col("__sL") / F.col("__mL"),
        "high_r2": F.col("__rH"), "low_r2": F.col("__rL"), "highs": F.col("__nH").cast("int"), "lows": F.col("__nL").cast("int"),
    })
    f = f.filter(
        (F.col("bar_ix") >= lookback + 2 * k + 5) & (F.least("highs", "lows") >= least_pivots) & (F.col("high_drift") <= most_high_drift)
        & (F.col("low_drift") >= least_low_drift) & (F.least("high_r2", "low_r2") >= least_r2)
    )
    stop = F.col("high") * (1 + buffer)
    f = f.withColumns({"entry": F.col("close"), "stop": stop, "target": F.when(stop > F.col("close"), F.col("close") - reward * (stop - F.col("close")))})
    return f.select("symbol", "trade_date", "bar_ix", "high_drift", "low_drift", "high_r2", "low_r2", "highs", "lows", "entry", "stop", "target")
