"""Verdicts, risk checks, blends, load plans and other compositions of earlier operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import clamp
from tapewright.functions.windows import BARS as P
from tapewright.operators import cross_section, indicators, kernels, scoring
from tapewright.operators.signals import range_frame


def macd_zero_cross(bars: DataFrame) -> DataFrame:
    """MACD crosses zero on the side of the 200-bar EMA, without another cross in the six bars before."""
    f = kernels.recursive(bars)
    f = f.withColumn("cross", F.when((F.col("macd") > 0) & (P.lag("macd") <= 0), 1).when((F.col("macd") < 0) & (P.lag("macd") >= 0), -1).otherwise(0))
    f = f.withColumn("recent", F.coalesce(F.sum(F.abs("cross")).over(P.WP(6)), F.lit(0)))
    return f.filter((F.col("recent") == 0) & (((F.col("cross") == 1) & (F.col("close") > F.col("ema200"))) | ((F.col("cross") == -1) & (F.col("close") < F.col("ema200")))))


def flat_bases(bars: DataFrame, longest: int = 35, least: int = 12, height: float = 0.06) -> DataFrame:
    """Longest flat stretches (high to low within ``height``) of each symbol, taken greedily from the left without
    overlap: the next base starts where the one before ends, so it is a fold."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ix", ignore_index=True)
        high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        out, i = [], 0
        while i + least <= len(pdf):
            for n in range(min(longest, len(pdf) - i), least - 1, -1):
                top, bottom = high[i : i + n].max(), low[i : i + n].min()
                if top / bottom - 1 <= height:
                    out.append((pdf["symbol"][0], pdf["trade_date"][i], pdf["trade_date"][i + n - 1], n, top, bottom))
                    i += n
                    break
            else:
                i += 1
        return pd.DataFrame(out, columns=["symbol", "start_date", "end_date", "length", "top", "bottom"])

    return bars.groupBy("symbol").applyInPandas(fold, "symbol string, start_date date, end_date date, length int, top double, bottom double")


def spring_quality(bars: DataFrame) -> DataFrame:
    """Springs with how deep they went, where they closed and on what volume, as one score."""
    f = range_frame(bars).withColumn("rvol", F.col("volume") / P.prior(F.avg("volume"), 20)).filter("bar_ix > 45 and low < sup and close > sup")
    depth = 100 * (F.col("sup") - F.col("low")) / F.col("sup")
    pos = (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))
    f = f.withColumns({"depth_pct": depth, "close_pos": pos})
    return f.withColumn("quality", 40 * clamp(1 - F.col("depth_pct") / 3, 0, 1) + 35 * F.col("close_pos") + 25 * clamp(F.col("rvol") / 2, 0, 1))


def volume_verdict(bars: DataFrame) -> DataFrame:
    """Six votes on volume between -6 and 6: slopes of OBV and VPT, force, CMF, volume on up days, spikes."""
    f = indicators.volume(bars)
    f = f.withColumn("up_vol", F.when(F.col("close") > P.lag("close"), F.col("volume")).otherwise(0.0))
    f = f.withColumns({
        "s_obv": P.full(F.regr_slope("obv", "bar_ix"), 20), "s_vpt": P.full(F.regr_slope("vpt", "bar_ix"), 20), "force10": P.full(F.avg("force_raw"), 10, "force_raw"),
        "up_share": P.full(F.sum("up_vol"), 20) / P.full(F.sum("volume"), 20),
    })
    sign = lambda c, t: F.when(F.col(c) > t, 1).when(F.col(c) < -t, -1).otherwise(0)
    spike = F.when((F.col("rvol_prior") >= 2) & (F.col("close") > F.col("open")), 1).when((F.col("rvol_prior") >= 2) & (F.col("close") < F.col("open")), -1).otherwise(0)
    share = F.when(F.col("up_share") > 0.55, 1).when(F.col("up_share") < 0.45, -1).otherwise(0)
    return f.withColumn("verdict", sign("s_obv", 1e-6) + sign("s_vpt", 1e-6) + sign("force10", 1e-6) + sign("cmf20", 0.05) + share + spike).filter("s_obv is not null")


def daily_weekly_verdict(bars: DataFrame) -> DataFrame:
    """BUY, TRIGGER, WAIT or AVOID from the daily evidence and the last completed week."""
    e = scoring.evidence(bars).select("symbol", "trade_date", "bar_ix", "close", "score", "n_bull", "n_bear")
    d = cross_section.weekly_onto_daily(e, cross_section.to_weekly(bars))
    weekly = F.when(F.col("week_close") > F.col("week_sma4"), 1).when(F.col("week_close") < F.col("week_sma4"), -1).otherwise(0)
    d = d.withColumn("weekly", weekly).withColumn("blend", clamp(F.col("score") + 5 * F.col("weekly"), 0, 100))
    v = F.when((F.col("blend") >= 65) & (F.col("weekly") >= 0), "BUY").when(F.col("blend") >= 60, "TRIGGER").when(F.col("blend") >= 40, "WAIT").otherwise("AVOID")
    return d.withColumn("verdict", v)


def risk_checks(bars: DataFrame, capital: float = 1e6, risk: float = 0.01) -> DataFrame:
    """The latest bar of each symbol: warnings and vetoes as lists, and the number of shares that risk allows."""
    f = scoring.score_frame(bars).withColumn("avg_value", P.full(F.avg(F.col("volume") * F.col("close")), 20))
    last = F.max("bar_ix").over(Window.partitionBy("symbol"))
    f = f.withColumn("last", last).filter("bar_ix = last")
    f = f.withColumns({"atr_pct": 100 * F.col("atr14") / F.col("close"), "rr": F.try_divide(F.col("hi20") - F.col("close"), F.col("close") - F.col("lo20")), "stretch": F.col("close") / F.col("sma20") - 1})
    warn = F.array_compact(F.array(F.when(F.col("atr_pct") > 2, "volatile"), F.when(F.col("stretch") > 0.05, "extended"), F.when(F.col("rsi_simple_100") > 70, "overbought")))
    veto = F.array_compact(F.array(F.when(F.col("avg_value") < 5000, "illiquid"), F.when((F.col("rr") < 0.5) | F.col("rr").isNull(), "reward"), F.when(F.col("close") < F.col("lo20"), "broken")))
    return f.select("symbol", "trade_date", F.array_join(warn, ",").alias("warnings"), F.array_join(veto, ",").alias("vetoes"), F.floor(capital * risk / (2 * F.col("atr14"))).cast("long").alias("shares"))


def blended_scores(quotes: DataFrame) -> DataFrame:
    """Market, sector and own change in one score for each symbol."""
    market, sector = Window.partitionBy(), Window.partitionBy("sector")
    q = quotes.withColumns({"m": F.avg("pct").over(market), "s": F.avg("pct").over(sector)})
    part = lambda c: clamp(50 + 10 * F.col(c), 0, 100)
    return q.withColumn("blend", 0.3 * part("m") + 0.3 * part("s") + 0.4 * part("pct"))


def load_plan(current: DataFrame, incoming: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """What a load would do with each incoming key: new, same, conflict, or duplicate within the load."""
    n = incoming.groupBy(key).agg(F.count("*").alias("n"), *[F.min(c).alias(f"{c}_new") for c in cols])
    j = n.join(current.select(key, *cols, F.lit(True).alias("there")), key, "left")
    same = F.lit(True)
    for c in cols:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_new"))
    return j.withColumn("plan", F.when(F.col("n") > 1, "duplicate").when(F.col("there").isNull(), "new").when(same, "same").otherwise("conflict"))


def daily_updates(events: DataFrame) -> DataFrame:
    """One row for each user, kind and day: inserted once, updated if a later value differs from the first."""
    g = events.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min_by("value", F.struct("ts", "event_id")).alias("first"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    return g.withColumn("status", F.when(F.col("n") == 1, "inserted").when(F.col("first") != F.col("last"), "updated").otherwise("unchanged"))


def incremental(stored: DataFrame, feed: DataFrame) -> DataFrame:
    """Rows of the feed from each symbol's last stored date on: that bar may have been revised, later ones are new."""
    mark = stored.groupBy("symbol").agg(F.max("trade_date").alias("mark"))
    return feed.join(mark, "symbol", "left").filter(F.col("mark").isNull() | (F.col("trade_date") >= F.col("mark"))).withColumn("kind", F.when(F.col("trade_date") == F.col("mark"), "recheck").otherwise("new"))


def event_offsets(bars: DataFrame, reach: int = 5) -> DataFrame:
    """Returns around each symbol's heaviest bar, by offset in bars: a join on the symbol and a handful of bar numbers."""
    day0 = bars.groupBy("symbol").agg(F.max_by(F.struct("bar_ix", "close"), F.struct("volume", -F.col("bar_ix"))).alias("e"))
    want = day0.select("symbol", "e", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("bar_ix", F.col("e.bar_ix") + F.col("offset"))
    return want.join(bars.select("symbol", "bar_ix", "close"), ["symbol", "bar_ix"]).select("symbol", "offset", (100 * (F.col("close") / F.col("e.close") - 1)).alias("ret_pct"))


def score_trades(ev: DataFrame, every: int = 5, least: float = 58.0, hold: int = 10) -> DataFrame:
    """Every k-th bar with a high enough score: in at the next open, out at the close ``hold`` bars on, with the worst low on the way."""
    f = ev.withColumns({"entry": P.lead("open", 1), "exit": P.lead("close", hold), "worst": P.ahead(F.min("low"), hold)})
    f = f.filter((F.col("bar_ix") % every == 0) & (F.col("score") >= least) & F.col("exit").isNotNull())
    return f.withColumns({"ret": F.col("exit") / F.col("entry") - 1, "worst_pct": F.col("worst") / F.col("entry") - 1, "r_multiple": F.try_divide(F.col("exit") - F.col("entry"), F.col("entry") - F.col("lo20"))})
