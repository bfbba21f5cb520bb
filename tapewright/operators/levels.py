"""Swing retracements, divergences, rebased series and the accuracy of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.windows import BARS as P
from tapewright.operators import indicators


def retracements(bars: DataFrame, n: int = 120) -> DataFrame:
    """Fibonacci levels of the dominant swing of the last n bars; the swing is up if its low came first."""
    w = P.W(n)
    f = bars.withColumns({
        "hi": P.full(F.max("high"), n), "lo": P.full(F.min("low"), n), "hi_ix": F.max_by("bar_ix", F.struct("high", -F.col("bar_ix"))).over(w), "lo_ix": F.min_by("bar_ix", F.struct("low", "bar_ix")).over(w),
    })
    f = f.withColumns({"up": F.col("lo_ix") < F.col("hi_ix"), "span": F.col("hi") - F.col("lo")})
    return f.withColumns({f"fib_{k}": F.when(F.col("up"), F.col("hi") - r * F.col("span")).otherwise(F.col("lo") + r * F.col("span")) for k, r in (("382", 0.382), ("500", 0.5), ("618", 0.618))})


def obv_divergence(bars: DataFrame, half: int = 15) -> DataFrame:
    """Lowest close of the later half below that of the earlier half, while OBV there is higher (and the mirror)."""
    f = indicators.volume(bars)
    late, early = P.base.rowsBetween(-(half - 1), 0), P.base.rowsBetween(-(2 * half - 1), -half)
    pick = lambda agg, w: agg("obv", F.struct("close", "bar_ix")).over(w)
    f = f.withColumns({
        "low2": F.min("close").over(late), "low1": F.min("close").over(early), "obv_low2": pick(F.min_by, late), "obv_low1": pick(F.min_by, early),
        "high2": F.max("close").over(late), "high1": F.max("close").over(early), "obv_high2": pick(F.max_by, late), "obv_high1": pick(F.max_by, early), "n": F.count("*").over(P.W(2 * half)),
    })
    return f.filter(F.col("n") == 2 * half).withColumn("divergence", F.when((F.col("low2") < F.col("low1")) & (F.col("obv_low2") > F.col("obv_low1")), "bullish").when((F.col("high2") > F.col("high1")) & (F.col("obv_high2") < F.col("obv_high1")), "bearish").otherwise("none"))


def rebased(bars: DataFrame, order: str) -> DataFrame:
    """Each symbol's closes on a base of 100 at its first bar."""
    first = F.first("close").over(Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("rebased", 100 * F.col("close") / first)


def alert_accuracy(alerts: DataFrame, horizons=(1, 3, 5), flat: float = 0.001) -> DataFrame:
    """For each kind of alert and horizon: how often the price went its way, against it, nowhere, or is not known yet."""
    rows = alerts.select("kind", "side", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("r")) for h in horizons])).alias("x")).select("kind", "side", "x.*")
    move = F.col("r") * F.col("side")
    return rows.groupBy("kind", "horizon").agg(
        F.count_if(move > flat).alias("correct"), F.count_if(move < -flat).alias("wrong"), F.count_if(F.abs(move) <= flat).alias("neutral"), F.count_if(F.col("r").isNull()).alias("no_data"),
    )
