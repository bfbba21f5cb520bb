"""Breadth with a verdict, strength as a score, entries with stops and the quality of a trade's structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.scalars import clamp
from tapewright.functions.windows import BARS as P


def rs_score(rs: DataFrame) -> DataFrame:
    """Blended excess return as 0 to 100: a quarter above or below the index is an end of the scale."""
    return rs.withColumns({"rs_score": clamp(50 + 200 * F.col("rs"), 0, 100), "outperforming": F.col("rs") > 0})


def breadth(bars: DataFrame, day: str, month: int = 4, mean: int = 20) -> DataFrame:
    """How many symbols rose, stand above their cloud and above their mean, on each date from which the cloud is known."""
    mid = lambda n: F.when(F.count("*").over(P.W(n)) == n, (F.max("high").over(P.W(n)) + F.min("low").over(P.W(n))) / 2)
    f = bars.withColumns({"lead": (mid(9) + mid(26)) / 2, "base": mid(52), "mean": P.full(F.avg("close"), mean), "was": P.lag("close", month)})
    f = f.withColumns({"lead": P.lag("lead", 26), "base": P.lag("base", 26)}).filter("base IS NOT NULL")
    close = F.col("close")
    out = f.groupBy(day).agg(
        F.count("*").alias("n"), F.count_if(close > F.col("was")).alias("advancing"), F.count_if(close > F.greatest("lead", "base")).alias("above_cloud"), F.count_if(close > F.col("mean")).alias("trend_up"),
    )
    n, up = F.col("n"), F.col("advancing")
    down, above = n - up, 100.0 * F.col("above_cloud") / n
    regime = F.when((above > 60) & ((down == 0) | (up > 1.2 * down)), "RISK-ON").when((above < 35) | ((down > 0) & (up < 0.6 * down)), "RISK-OFF").otherwise("MIXED")
    return out.withColumns({"ad_ratio": F.round(F.try_divide(up, down), 4), "regime": regime})


def entries(evidence: DataFrame, liquidity: Column | None = None) -> DataFrame:
    """Three entries, the stop's distance in true ranges with a class, and a score of the trade's structure: agreement,
    stop, liquidity (0 to 1; a half where it is not known), reward to risk, the trend above it."""
    f = evidence.withColumn("stop_atr", F.round(F.when(F.col("atr14") > 0, F.abs(F.col("close") - F.col("lo20")) / F.col("atr14")), 2))
    stop, bull, bear = F.col("stop_atr"), F.col("n_bull"), F.col("n_bear")
    setup = F.when(bull + bear > 0, 100.0 * F.abs(bull - bear) / (bull + bear)).otherwise(0.0)
    stop_points = F.when(stop.between(1, 3), 90).when(stop.between(0.8, 5), 60).when(stop.isNotNull(), 25).otherwise(50)
    reward = F.when(F.col("rr") > 0, F.least(F.lit(100.0), F.col("rr") / 3 * 100)).otherwise(0.0)
    trend = F.when(F.col("sma50").isNull(), 40).when((F.col("close") > F.col("sma50")) == (bull > bear), 70).otherwise(20)
    fluid = 100 * F.coalesce(liquidity if liquidity is not None else F.lit(None).cast("double"), F.lit(0.5))
    return f.withColumns({
        "aggressive": F.col("close"), "standard": F.col("hi20"), "conservative": F.round(F.col("hi20") * 1.01, 2),
        "stop_class": F.when(stop < 0.8, "tight").when(stop > 5, "wide").when(stop.isNotNull(), "sane"), "quality": 0.3 * setup + 0.2 * stop_points + 0.2 * fluid + 0.2 * reward + 0.1 * trend,
    })
